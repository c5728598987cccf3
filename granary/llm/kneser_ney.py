"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is an n-gram model over bytes. Counts of the highest order, continuation counts of the lower
ones, three discounts an order from counts of counts, and the interpolated probabilities are all made
by Spark joins and aggregations. For scoring, the tables are dealt into shards by the two bytes before the
one that is predicted, and so are the distinct n-grams of each block of texts: all that a position needs
(its n-grams, its contexts, its shorter n-grams) meets it in one shard, whose task joins them and sends the
log-probabilities back to the block. Only n-grams of one and two bytes, at most 66 thousand, are broadcast.
Thresholds are the median of trusted text that the model has not seen and a number of median deviations
above it, language by language, so a few odd documents among the trusted ones do not move them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import DEALT, dealt, finished_in_waves, in_blocks, rows_of
from .hashindex import HashIndex, Tally
from .scratch import intermediate, lasting, stored
from .textarrays import Texts, chunks

ORDER = 5
END = 3  # a byte that ends each text
#: Entries of one shard, about: some 50 bytes each in a worker. Those of two bytes stay together.
SHARD_ENTRIES = 1 << 19
#: Bytes of text of a block: the larger, the fewer n-grams travel twice. It is worked through some texts at a time.
BLOCK_BYTES = 32 << 20
#: Of the blocks, one in so many meets its answers at a time: the rest of the texts lies on disk once.
WAVES = 4
_TWO = np.uint64(0xFFFF)


def _codes(column: pa.Array, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, packed n-gram of every position, its text): each text has an end, and newlines before."""
    for lo, hi in chunks(column):
        texts = Texts(column.slice(lo, hi - lo), lower=False)
        # room of order bytes before each text: its own newline and copies of it
        size = texts.sizes + 1
        begin = np.cumsum(size + order - 1) - size
        flat = np.full(int((size + order - 1).sum()), 10, dtype=np.uint8)
        doc = np.repeat(np.arange(len(size)), texts.sizes)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(texts.sizes) - texts.sizes, texts.sizes)
        flat[begin[doc] + nth] = texts.flat[texts.starts[doc] + nth]
        flat[begin + texts.sizes] = END
        code = np.zeros(len(flat), dtype=np.uint64)
        for k in range(order):
            code[order - 1 :] |= flat[order - 1 - k : len(flat) - k].astype(np.uint64) << np.uint64(8 * k)
        owner = np.repeat(np.arange(len(size)), size)
        at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(len(owner))
        yield lo, code[at], owner


def _grams(order: int):
    def run(batches):
        tally = Tally()
        row = lambda part: pa.RecordBatch.from_arrays([pa.array(part[0].astype(np.int64)), pa.array(part[1])], ["g", "c"])
        for batch in batches:
            for _, code, _ in _codes(batch.column(0), order):
                if full := tally.add(code):
                    yield row(full)
        yield row(tally.take())

    return run


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """The modified Kneser-Ney discounts of counts 1, 2 and 3 or more."""
    r = counts.agg(*(F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4))).first()
    n1, n2, n3, n4 = (float(r[f"n{k}"]) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d = [k - (k + 1) * y * (up / n if n else 0.5) for k, n, up in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d, strict=True))


def _smoothed(counts: DataFrame, order: int) -> tuple[DataFrame, DataFrame]:
    """(ctx, total, gamma) and (g, ctx, a) of one order: discounted shares and the weight left over."""
    d1, d2, d3 = discounts(counts)
    counts = counts.withColumn("ctx", F.shiftrightunsigned("g", 8))
    of = lambda k: F.count_if(F.col("c") == k if k < 3 else F.col("c") >= 3)
    ctx = counts.groupBy("ctx").agg(F.sum("c").alias("total"), of(1).alias("n1"), of(2).alias("n2"), of(3).alias("n3"))
    ctx = ctx.select("ctx", "total", ((d1 * F.col("n1") + d2 * F.col("n2") + d3 * F.col("n3")) / F.col("total")).alias("gamma"))
    cut = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
    grams = counts.join(ctx, "ctx").select("g", "ctx", ((F.col("c") - cut) / F.col("total")).alias("a"), "gamma")
    return ctx, grams


def train(trusted: DataFrame, order: int = ORDER) -> DataFrame:
    """The model of ``trusted`` (text) as rows (n, context, key, value): log10 of p, or of a context's gamma.

    ``key`` packs the bytes of an n-gram or a context, the last one lowest. Nulls and empty texts count
    as ends only.
    """
    top = trusted.select("text").mapInArrow(_grams(order), "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))
    level = stored(top, "grams")
    levels = {order: level}
    for n in range(order - 1, 0, -1):  # types of the order above, by what follows their first byte
        level = stored(level.groupBy(level["g"].bitwiseAND(F.lit((1 << 8 * n) - 1)).alias("g")).agg(F.count("*").alias("c")), "grams")
        levels[n] = level
    rows, below = [], None
    for n in range(1, order + 1):
        ctx, grams = _smoothed(levels[n], n)
        if below is None:
            p = grams.select("g", (F.col("a") + F.col("gamma") / 256).alias("p"))
        else:
            short = grams["g"].bitwiseAND(F.lit((1 << 8 * (n - 1)) - 1))
            p = grams.withColumn("short", short).join(below.select(F.col("g").alias("short"), F.col("p").alias("q")), "short").select("g", (F.col("a") + F.col("gamma") * F.col("q")).alias("p"))
        below = stored(p, "p")
        rows.append(below.select(F.lit(n).alias("n"), F.lit(False).alias("context"), F.col("g").alias("key"), F.log10("p").alias("value")))
        rows.append(ctx.select(F.lit(n - 1).alias("n"), F.lit(True).alias("context"), F.col("ctx").alias("key"), F.log10("gamma").alias("value")))
    model = rows[0]
    for r in rows[1:]:
        model = model.unionByName(r)
    return stored(model, "model")


_ROW = np.dtype([("n", "<i4"), ("context", "<i4"), ("key", "<u8"), ("value", "<f8")])


def _rows(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    out = np.zeros(table.num_rows, _ROW)
    for c in _ROW.names:
        out[c] = table.column(c).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(c).to_numpy()
    return out


def _shard(two: np.ndarray, shards: int) -> np.ndarray:
    """Where the n-grams go that have these two bytes before the predicted one."""
    return (((two & _TWO) * np.uint64(40503) & _TWO) * np.uint64(shards) >> np.uint64(16)).astype(np.int64)


class Scorer:
    """Log-probabilities from the rows of a model that belong together, and the short ones that all need."""

    def __init__(self, rows: np.ndarray, order: int):
        self.order = order
        pick = lambda n, context: rows[(rows["n"] == n) & (rows["context"] == context)]
        index = lambda x: (HashIndex(x["key"]), x["value"].astype(np.float32))
        self.grams = {n: index(pick(n, 0)) for n in range(2, order + 1)}
        self.contexts = {n: index(pick(n, 1)) for n in range(1, order)}
        gamma, one = pick(0, 1)["value"], pick(1, 0)
        self.single = np.full(256, float(gamma[0]) - np.log10(256) if len(gamma) else -np.log10(257))
        self.single[one["key"].astype(np.int64)] = one["value"]

    def score(self, code: np.ndarray) -> np.ndarray:
        """log10 of the probability of the last byte of each n-gram."""
        out = np.zeros(len(code))
        live = np.arange(len(code))
        for n in range(self.order, 1, -1):
            if not len(live):
                return out
            index, values = self.grams[n]
            key = code[live] & np.uint64((1 << 8 * n) - 1)
            at = index.find(key)
            hit = at >= 0
            out[live[hit]] += values[at[hit]]
            live, key = live[~hit], key[~hit]
            index, values = self.contexts[n - 1]
            at = index.find(key >> np.uint64(8))
            seen = at >= 0
            out[live[seen]] += values[at[seen]]
        out[live] += self.single[(code[live] & np.uint64(255)).astype(np.int64)]
        return out


def _encoded(log10_p: np.ndarray) -> bytes:
    """Three bytes each: steps of 2**-18, down to -64."""
    steps = np.clip(np.round(-log10_p * (1 << 18)), 0, (1 << 24) - 1).astype("<u4")
    return np.ascontiguousarray(steps).view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def _decoded(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 3, 4), np.uint8)
    out[:, :3] = np.frombuffer(data, np.uint8).reshape(-1, 3)
    return out.view("<u4").ravel() / -float(1 << 18)


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    for at in np.split(order, cuts) if len(order) else []:
        yield int(shard[at[0]]), at


def _pack_model(shards: int):
    def run(batches):
        for batch in batches:
            rows = _rows(batch)
            two = np.where(rows["context"] == 1, rows["key"], rows["key"] >> np.uint64(8))
            parts = list(_by_shard(_shard(two, shards)))
            yield dealt([k for k, _ in parts], 0, -1, [rows[at].tobytes() for _, at in parts], [b""] * len(parts))

    return run


def _block_codes(rows: pa.Table, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The n-gram of every position of a block's texts, and its row, some texts at a time."""
    done = 0
    for x in rows.column("text").chunks:
        for lo, code, owner in _codes(x, order):
            yield code, done + lo + owner
        done += len(x)


def _in_shards(rows: pa.Table, order: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a block, shard by shard, and the shard of each."""
    distinct = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.unique(code) for code, _ in _block_codes(rows, order))]))
    shard = _shard(distinct >> np.uint64(8), shards)
    by = np.argsort(shard, kind="stable")
    return distinct[by], shard[by]


def _ask(order: int, shards: int):
    def run(batches):
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                codes, shard = _in_shards(rows_of(data.as_py()), order, shards)
                parts = list(_by_shard(shard))
                # the bytes of an n-gram, no more
                pack = lambda x: np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, :order].tobytes()
                yield dealt([k for k, _ in parts], 1, number, [pack(codes[at]) for _, at in parts], [b""] * len(parts))

    return run


def _answer(short, order: int):
    def run(batches):
        now, rows, scorer = None, [], None
        for batch in batches:
            out = [], [], []
            for share, kind, block, keys in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if share != now:
                    now, rows, scorer = share, [short.value], None
                if kind == 0:
                    rows.append(np.frombuffer(keys, _ROW))
                    continue
                if scorer is None:
                    scorer, rows = Scorer(np.concatenate(rows), order), []
                codes = np.zeros((len(keys) // order, 8), np.uint8)
                codes[:, :order] = np.frombuffer(keys, np.uint8).reshape(-1, order)
                for column, x in zip(out, (block, share, _encoded(scorer.score(codes.view("<u8").ravel()))), strict=True):
                    column.append(x)
            n = len(out[0])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary()), pa.array([b""] * n, pa.binary())], ["block", "share", "log10_p", "none"])

    return run


def _summed(names: list[str], order: int, shards: int):
    def finish(data: bytes, answers: list[bytes], _):
        rows = rows_of(data)
        index, values = HashIndex(_in_shards(rows, order, shards)[0]), _decoded(b"".join(answers))
        total, size = np.zeros(rows.num_rows), np.zeros(rows.num_rows, np.int64)
        for code, owner in _block_codes(rows, order):
            total += np.bincount(owner, values[index.find(code)], rows.num_rows)
            size += np.bincount(owner, minlength=rows.num_rows)
        out = rows.select(names).combine_chunks().append_column("log10_p", pa.array(total)).append_column("n_symbols", pa.array(size))
        yield from out.to_batches()

    return finish


def perplexity(docs: DataFrame, model: DataFrame, order: int = ORDER, shard_entries: int = SHARD_ENTRIES, block_bytes: int = BLOCK_BYTES, waves: int = WAVES) -> DataFrame:
    """``docs`` without text, with log10_p, n_symbols (bytes and the end) and perplexity of whole texts.

    A null or empty text has a perplexity of null. Rows stay as they are, repeated ones too; clashing
    columns are replaced.
    """
    spark = docs.sparkSession
    columns = [c for c in docs.columns if c not in ("text", "log10_p", "n_symbols", "perplexity")]
    model = model.withColumn("context", F.col("context").cast("int"))
    # contexts of at most one byte and n-grams of at most two: 2 * 256 + 256 ** 2 rows and one at most
    brief = F.col("n") < F.when(F.col("context") == 1, 2).otherwise(3)
    short = spark.sparkContext.broadcast(_rows(model.where(brief).toArrow()))
    shards = min(1 << 16, max(spark.sparkContext.defaultParallelism, model.count() // shard_entries))
    blocks = in_blocks(docs.select(*columns, "text"), block_bytes)
    asked = model.where(~brief).mapInArrow(_pack_model(shards), DEALT).unionByName(blocks.mapInArrow(_ask(order, shards), DEALT))
    gathered = asked.repartitionById(shards, "share").sortWithinPartitions("share", "kind")
    answers = gathered.mapInArrow(_answer(short, order), "block long, share int, log10_p binary, none binary")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in columns), "log10_p double, n_symbols long"])
    out = finished_in_waves(blocks, answers, _summed(columns, order, shards), schema, waves)
    return out.withColumn("perplexity", F.when(F.col("n_symbols") > 1, F.pow(F.lit(10.0), -F.col("log10_p") / F.col("n_symbols"))))


def fold(doc_id: Column, parts: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def classify(docs: DataFrame, trusted_ids: DataFrame, deviations: float = 6.0, calibration_parts: int = 5, least_calibrated: int = 20) -> DataFrame:
    """(doc_id, lang, trusted, log10_p, n_symbols, perplexity, threshold, kept), a row for each of ``docs``.

    ``docs`` has doc_id, text and lang; ``trusted_ids`` the doc_id of trusted documents, of which one in
    ``calibration_parts`` (by crc32 of the id) sets thresholds and the others train. A document is kept
    when its perplexity is at most the median of its language's calibration documents and ``deviations``
    times their median absolute deviation, 1.4826 of which are a standard deviation of normal values
    (of all of them, for a null language and one with fewer than ``least_calibrated``). Null
    and empty texts are not kept; with no calibration at all everything else is. Clashing columns are
    ignored, repeated rows stay.
    """
    trusted_ids = trusted_ids.select("doc_id").where("doc_id is not null").distinct()
    rows = docs.select("doc_id", "text", "lang")
    part = fold(F.col("doc_id"), calibration_parts)
    # the ids grow with the corpus, so they are never broadcast: the plan is the same at every size
    with intermediate(docs.sparkSession):
        model = train(rows.where(part != 0).join(trusted_ids.where(part != 0).hint("shuffle_hash"), "doc_id", "left_semi"))
        scored = lasting(perplexity(rows, model), "scored")
    marked = scored.join(trusted_ids.withColumn("trusted", F.lit(True)), "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    held = marked.where(F.col("trusted") & (part == 0) & F.col("perplexity").isNotNull())
    median = lambda x: F.percentile_approx(x, F.lit(0.5), F.lit(10000))
    cut = (F.first("mid") + deviations * 1.4826 * median(F.abs(F.col("perplexity") - F.col("mid")))).alias("cut")
    mids = held.where("lang is not null").groupBy("lang").agg(median("perplexity").alias("mid"), F.count("*").alias("n")).where(F.col("n") >= least_calibrated)
    mids = stored(mids, "medians")  # a row for each language: its size is known when the join is planned
    by_lang = held.join(mids, "lang").groupBy("lang").agg(cut)
    middle = held.agg(median("perplexity").alias("mid")).first()["mid"]
    every = held.withColumn("mid", F.lit(middle).cast("double")).agg(cut).first()["cut"]
    out = marked.join(by_lang, "lang", "left").withColumn("threshold", F.coalesce("cut", F.lit(every).cast("double"), F.lit(float("inf"))))
    kept = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False))
    return out.select("doc_id", "lang", "trusted", "log10_p", "n_symbols", "perplexity", "threshold", kept.alias("kept"))
