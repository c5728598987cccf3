"""Exact quantiles of groups of any size.

The aggregate form (``aggs.quantile``) keeps a group's distinct values in one task, which suits groups
of up to some ten million. The form here sorts instead: distinct values with their counts are
range-partitioned by group and value, counts are added up across partitions, and only the partitions
that hold a rank which the quantiles need go on, so neither a group nor a value that holds most of a
table costs a task more than its share.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import pinned


def exact_quantiles(df: DataFrame, column: str, probabilities: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """(…keys, n, q): q holds the quantile of each probability, interpolated at (n - 1) p; nulls and NaN do not count."""
    if any(not 0 <= p <= 1 for p in probabilities):
        raise ValueError("Probabilities lie between 0 and 1")
    x = F.col(column).cast("double")
    # equal values are one row with their count, so no partition grows with the copies of a value
    rows = df.where(x.isNotNull() & ~F.isnan(x)).select(*keys, x.alias("x_")).groupBy(*keys, "x_").agg(F.count("*").alias("c_"))
    order = [*(F.col(k).asc_nulls_first() for k in keys), F.col("x_").asc()]
    placed = pinned(rows.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()))

    parts = placed.groupBy(*keys, "part_").agg(F.sum("c_").alias("held_"))
    own = Window.partitionBy(*keys)  # a row for each partition that the group reaches
    parts = parts.withColumns({"before_": F.coalesce(F.sum("held_").over(own.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "n_": F.sum("held_").over(own)})
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probabilities)))
    place = lambda s: (F.col("n_") - 1) * s["p"]
    near = lambda first, end: F.filter(steps, lambda s: (place(s) > first - 1) & (place(s) < end))
    # only partitions that hold a rank of some quantile are put in order
    parts = parts.where(F.size(near(F.col("before_"), F.col("before_") + F.col("held_"))) > 0)
    on = F.col("a.part_") == F.col("b.part_")
    for k in keys:
        on = on & F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`"))
    found = placed.alias("a").join(parts.alias("b"), on).select(*(F.col(f"a.`{k}`") for k in keys), "x_", "c_", "n_", "before_", F.col("a.part_").alias("part_"))
    running = Window.partitionBy(*keys, "part_").orderBy("x_").rowsBetween(Window.unboundedPreceding, 0)
    ranked = found.withColumn("end_", F.col("before_") + F.sum("c_").over(running)).withColumn("first_", F.col("end_") - F.col("c_"))

    wanted = ranked.select(*keys, "x_", "n_", "first_", "end_", F.explode(near(F.col("first_"), F.col("end_"))).alias("s"))
    low = F.floor(place(F.col("s")))
    beyond = place(F.col("s")) - low  # the share of the next rank
    has_low, has_next = low >= F.col("first_"), low + 1 < F.col("end_")
    share = F.when(has_low & has_next, 1.0).when(has_low, 1 - beyond).otherwise(beyond)
    each = wanted.groupBy(*keys, "n_", F.col("s.i").alias("i_")).agg(F.sum(F.when(share > 0, share * F.col("x_")).otherwise(0.0)).alias("q_"))
    out = each.groupBy(*keys, "n_").agg(F.sort_array(F.collect_list(F.struct("i_", "q_"))).alias("q_"))
    return out.select(*keys, F.col("n_").alias("n"), F.transform("q_", lambda s: s["q_"]).alias("q"))
