"""Mixing sources to target weights by systematic sampling.

Each source gets a share of all words by its weight, at most ``most_copies`` times its own size; what
that cuts off goes to the others by weight. Every document of a source has the same expected number of
copies, target / size. Along the source, ordered by size and id, these are summed up from one random
offset, and a copy is emitted for each whole number that a document's stretch crosses. Ordering by size
spreads the copies evenly over short and long documents, so the words taken stay near the target.

Places within a source come from a range partitioning of (source, size, id) and a table of row counts
by partition and source, so no task ever holds a source.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored

WORD_BREAK = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of other than ASCII white space; 0 for null."""
    text = F.coalesce(text, F.lit(""))
    return F.size(F.array_remove(F.split(text, WORD_BREAK, -1), "")).cast("long")


def targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[int], most_copies: int = 3) -> dict[str | None, float]:
    """Words to take of each source: weights repeat along the sources by code point, null last.

    Sources are capped in order of how soon the cap binds; each cap frees words for the rest.
    """
    ordered = sorted((s for s in sizes), key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(ordered)}
    size = dict(ordered)
    left, weigh, out = sum(size.values()), sum(weight.values()), {}
    for s in sorted(size, key=lambda s: (most_copies * size[s] / weight[s], s is None, s or "")):
        cap = most_copies * size[s]
        if weight[s] * left > cap * weigh:
            out[s] = float(cap)
            left, weigh = left - cap, weigh - weight[s]
        else:
            out[s] = None
    return {s: float(weight[s] * left) / weigh if t is None else t for s, t in out.items()}


def offset(source: str | None, seed: int) -> float:
    """The source's one random number, a multiple of 2**-16 in [0, 1)."""
    return int(hashlib.md5(f"{seed}|{'' if source is None else 's' + source}".encode()).hexdigest()[:4], 16) / 65536


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most_copies: int = 3, seed: int = 11) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken), a row for each row of ``docs``.

    ``docs`` has doc_id, text and source. size counts words (null: 0), taken is copies * size. A null
    source is a source of its own. A source without words has target 0 and takes nothing. Ties of size
    go by doc_id, nulls first; rows equal in all three are interchangeable. The number of sources is that
    of a mixture's configuration: one row of each comes to the driver. Reruns agree.
    """
    return _decide(docs, weights, most_copies, seed).drop("h")


def _decide(docs: DataFrame, weights: Sequence[int], most_copies: int, seed: int) -> DataFrame:
    """The columns of mix(), and h, a hash of the text, which breaks ties of id and size."""
    spark = docs.sparkSession
    # range partitions are drawn from a sample, so what they deal is written first: texts are read once
    rows = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("h")), "sizes")
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id").asc_nulls_first(), F.col("h")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(placed.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "placed")

    ranges = placed.groupBy("source", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.sum("size").alias("words"))
    ranges = stored(ranges, "ranges")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.select("source", "part", (before - F.col("first")).alias("shift"))

    sizes = {r["source"]: r["words"] for r in ranges.groupBy("source").agg(F.sum("words").alias("words")).collect()}
    goal = targets(list(sizes.items()), weights, most_copies) if sizes else {}
    plan = spark.createDataFrame([(s, sizes[s], goal[s], offset(s, seed)) for s in goal], "source string, source_size long, target double, u double")
    starts = starts.alias("x").join(plan.alias("y"), F.col("x.source").eqNullSafe(F.col("y.source"))).select("x.source", "x.part", "shift", "source_size", "target", "u")

    joined = placed.alias("p").join(starts.alias("s"), (F.col("p.part") == F.col("s.part")) & F.col("p.source").eqNullSafe(F.col("s.source")))
    rank = F.col("at") + F.col("shift")
    per = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crossed = F.floor((rank + 1) * per + F.col("u")) - F.floor(rank * per + F.col("u"))
    copies = F.least(F.greatest(crossed, F.floor(per)), F.ceil(per)).cast("long")
    out = joined.select("p.doc_id", "p.source", "p.size", "p.h", "source_size", "target", copies.alias("copies"))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most_copies: int = 3, seed: int = 11) -> DataFrame:
    """The rows of ``docs`` that the mix takes, once for each copy, with copy_no from 1 (a clashing one is replaced).

    Rows and decisions meet by a hash of id, source and text, which deals out ids that are null or
    repeated; rows equal in all three are interchangeable and meet by their number.
    """
    key = F.xxhash64("doc_id", "source", "h").alias("key")
    numbered = lambda df: df.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("key")))
    own = docs.select("doc_id", "source", F.xxhash64("text").alias("h"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    own = numbered(own.select(key, "row")).alias("a")
    taken = numbered(_decide(docs, weights, most_copies, seed).where("copies > 0").select(key, "copies")).alias("b")
    # one equality only: both sides are already dealt by the key, so the texts move once
    both = own.join(taken.hint("merge"), (F.col("a.key") == F.col("b.key")) & (F.col("a.nth") - F.col("b.nth") == 0))
    copies = F.explode(F.sequence(F.lit(1), F.col("b.copies").cast("int"))).alias("copy_no")
    return both.select("a.row", copies).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "copy_no"), "copy_no")


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS words, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS i FROM d GROUP BY source),
w AS (SELECT source, words, [5, 2, 1][(i % 3 + 1)::INT]::BIGINT AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 3 * words / weight, source IS NULL, encode(source)) AS k,
             sum(words) OVER ()::BIGINT - coalesce(sum(3 * words) OVER (ORDER BY 3 * words / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lft,
             sum(weight) OVER (ORDER BY 3 * words / weight DESC, source IS NULL DESC, encode(source) DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS wgh FROM w),
c AS (SELECT coalesce(min(k), 1000000000) AS k0 FROM o WHERE weight * lft <= 3 * words * wgh),
f AS (SELECT lft, wgh FROM o, c WHERE k = k0),
t AS (SELECT source, words, CASE WHEN k < k0 THEN (3 * words)::DOUBLE ELSE (weight * (SELECT lft FROM f))::DOUBLE / (SELECT wgh FROM f) END AS target,
             ('0x' || substr(md5('11|' || CASE WHEN source IS NULL THEN '' ELSE 's' || source END), 1, 4))::INT / 65536.0::DOUBLE AS u FROM o, c),
r AS (SELECT d.doc_id, d.size, t.words AS source_size, t.target, CASE WHEN t.words > 0 THEN t.target / t.words ELSE 0.0::DOUBLE END AS per, t.u,
             row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS FIRST) AS n
      FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target, (least(greatest(floor(n * per + u) - floor((n - 1) * per + u), floor(per)), ceil(per)) * size)::BIGINT AS taken FROM r
"""
