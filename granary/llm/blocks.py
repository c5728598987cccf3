"""Texts in blocks of a few megabytes, each one value of a table.

A block can be asked about elsewhere (its distinct keys travel as packed arrays) and finished later: its
rows come in the same order whenever it is read, however tasks are cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, stored
from .textarrays import chunks

#: Of a probe or a packed row: where it goes (share), what it is (kind), whose it is (block), and two arrays.
DEALT = "share int, kind int, block long, keys binary, more binary"


def _packed_rows(limit: int):
    def run(batches):
        held, size, n = [], 0, 0
        task = TaskContext.get().partitionId() << 32

        def block():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for b in held:
                    out.write_batch(b)
            return pa.RecordBatch.from_arrays([pa.array([task + n], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "data"])

        for batch in batches:
            for lo, hi in chunks(batch.column(batch.schema.get_field_index("text"))):
                part = batch.slice(lo, hi - lo)
                held.append(part)
                size += part.column(part.schema.get_field_index("text")).nbytes + 16 * len(part)
                if size >= limit:
                    yield block()
                    held, size, n = [], 0, n + 1
        if held:
            yield block()

    return run


def in_blocks(docs: DataFrame, limit: int) -> DataFrame:
    """(block, data): the rows of ``docs`` (text, ...) by about ``limit`` bytes of text, written once."""
    return stored(docs.mapInArrow(_packed_rows(limit), "block long, data binary"), "blocks")


def rows_of(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def dealt(share: np.ndarray, kind: int, block: int, keys: list[bytes], more: list[bytes]) -> pa.RecordBatch:
    """Rows of the form ``DEALT``."""
    n = len(keys)
    columns = [pa.array(np.asarray(share, np.int32)), pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, block, np.int64)), pa.array(keys, pa.binary()), pa.array(more, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["share", "kind", "block", "keys", "more"])


def finished(blocks: DataFrame, answers: DataFrame, finish, schema: str) -> DataFrame:
    """The rows that ``finish(data, answers of each share in order)`` makes of every block.

    ``answers`` has block, share and two binary columns; ``finish`` gets a pair of lists of them.
    """
    a, b = answers.columns[2:]
    data = blocks.select("block", F.lit(-1).alias("share"), F.col("data").alias(a), F.lit(b"").alias(b))
    together = data.unionByName(answers).repartition("block").sortWithinPartitions("block", "share")

    def run(batches) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            for share, x, y in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if share < 0:
                    if now:
                        yield from finish(*now)
                    now = (x, [], [])
                else:
                    now[1].append(x)
                    now[2].append(y)
        if now:
            yield from finish(*now)

    return together.mapInArrow(run, schema)


def finished_in_waves(blocks: DataFrame, answers: DataFrame, finish, schema: str, waves: int) -> DataFrame:
    """As ``finished``, of stored rows: about one in ``waves`` of the blocks meets its answers at a time.

    What is shuffled of a wave goes when its rows are written, so no more than that share of the texts lies
    on disk twice. The tables of blocks and of answers go at the end.
    """
    answers = stored(answers, "answers")
    # block numbers follow the tasks that wrote them: a file holds blocks of one wave or two, and others skip it by its statistics
    found = blocks.agg(F.percentile_approx("block", [k / waves for k in range(1, waves)] or [1.0]).alias("at"), F.max("block").alias("last")).first()
    cuts = sorted({x for x in found["at"] or [] if x < found["last"]})
    done = []
    for low, high in zip([-1, *cuts], [*cuts, (1 << 63) - 1], strict=True):
        of = (F.col("block") > low) & (F.col("block") <= high)
        done.append(stored(finished(blocks.where(of), answers.where(of), finish, schema), "wave"))
    discard(blocks)
    discard(answers)
    return reduce(DataFrame.unionByName, done)
