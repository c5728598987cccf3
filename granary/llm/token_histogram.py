"""Token counts as an exact histogram of encoded lengths.

Every text is encoded once; documents are then counted by length, and sums from the long end answer
totals, quantiles and truncated totals for every context limit. The histogram has as many rows as there
are distinct lengths; its sums run within blocks of lengths and over the few block totals.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored
from .textarrays import chunks

# Fixed value: the word pattern that byte_bpe_50k was made with.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BLOCK = 1024


@lru_cache(maxsize=2)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    pairs = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


def _lengths(ranks, pattern: str):
    def run(batches):
        code = _encoding(ranks.value, pattern)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            out = np.zeros(len(batch), np.int64)
            for lo, hi in chunks(column):
                for i, text in enumerate(column.slice(lo, hi - lo).to_pylist()):
                    out[lo + i] = len(code.encode_ordinary(text)) if text else 0
            yield pa.RecordBatch.from_arrays([*(c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != "text"), pa.array(out)], [*(n for n in batch.schema.names if n != "text"), "n_tokens"])

    return run


def token_lengths(docs: DataFrame, ranks_path: str, pattern: str = PATTERN) -> DataFrame:
    """``docs`` without text, with n_tokens of the whole text; a null or empty text has 0.

    Rows stay as they are, repeated ones too; a column named n_tokens is replaced.
    ``ranks_path`` names a tiktoken ranks file that the driver can read; its bytes, whose size is that of
    the vocabulary, are broadcast. Strings that look like special tokens are ordinary text.
    """
    with open(ranks_path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    docs = docs.drop("n_tokens")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"), "n_tokens long"])
    return docs.mapInArrow(_lengths(ranks, pattern), schema)


def length_histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, n_docs, docs_at_least, tokens_at_least, docs_longer, truncated_tokens, quantile).

    One row for each length that occurs, for which as a context limit: docs_longer documents would be
    cut, truncated_tokens is what remains in all, and quantile is the share of documents that fit.
    Repeated rows count each time, other columns are ignored. No rows give no rows.
    """
    # read twice below, and far cheaper to read than to encode again
    hist = stored(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "lengths").withColumn("block", F.floor(F.col("n_tokens") / _BLOCK))
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    up = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # one row for 1024 lengths
    every = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(up), zero).alias("d"), F.coalesce(F.sum("t").over(up), zero).alias("t"), F.sum("d").over(every).alias("all_d"), F.sum("t").over(every).alias("all_t"))
    own = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    out = hist.withColumns({"d_own": F.sum("n_docs").over(own), "t_own": F.sum(F.col("n_docs") * F.col("n_tokens")).over(own)}).join(blocks, "block")
    at_least, tokens = F.col("d") + F.col("d_own"), F.col("t") + F.col("t_own")
    longer, beyond = at_least - F.col("n_docs"), tokens - F.col("n_docs") * F.col("n_tokens")
    return out.select(
        "n_tokens",
        "n_docs",
        at_least.alias("docs_at_least"),
        tokens.alias("tokens_at_least"),
        longer.alias("docs_longer"),
        (F.col("all_t") - beyond + longer * F.col("n_tokens")).alias("truncated_tokens"),
        ((F.col("all_d") - longer) / F.col("all_d")).alias("quantile"),
    )


def for_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, n_docs, n_tokens, docs_longer, truncated_tokens) for any limits, from one pass of the histogram."""
    size, n = F.col("n_tokens"), F.col("n_docs")
    sums = [F.struct(F.lit(x).cast("long").alias("context_limit"), F.sum(n).alias("n_docs"), F.sum(n * size).alias("n_tokens"), F.sum(F.when(size > x, n).otherwise(0)).alias("docs_longer"), F.sum(n * F.least(size, F.lit(x))).alias("truncated_tokens")) for x in limits]
    return hist.agg(F.array(*sums).alias("r")).select(F.inline("r"))


def quantile_length(hist: DataFrame, q: float) -> DataFrame:
    """(n_tokens): the shortest length that at least the share ``q`` of all documents does not exceed."""
    return hist.where(F.col("quantile") >= q).agg(F.min("n_tokens").alias("n_tokens"))
