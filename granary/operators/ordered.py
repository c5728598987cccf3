"""Ordered-window operations over a whole frame, without bringing its rows to one task.

Rows get their number in the order (range partitions, sorted and counted) and fall into blocks of
consecutive numbers. A block also receives the few rows beside it that its windows look at, so windows
run block by block; running sums add the totals of the blocks before, one row for each block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import numbered

#: Rows of a block; a window that reaches further makes its blocks as large.
BLOCK = 1 << 16


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _blocks(df: DataFrame, order_by: Sequence[str], before: int = 0, after: int = 0) -> DataFrame:
    """``df`` with place_, block_ and own_: false for rows that a block only looks at."""
    size = max(BLOCK, before, after)
    rows = numbered(df, order_by, "place_").withColumn("home_", F.floor(F.col("place_") / size))
    at = F.col("place_") - F.col("home_") * size
    near = [F.lit(0)]
    if before:  # the last rows of a block come before those of the next
        near.append(F.when(at >= size - before, F.lit(1)))
    if after:
        near.append(F.when((at < after) & (F.col("home_") > 0), F.lit(-1)))
    rows = rows.withColumn("step_", F.explode(F.array_compact(F.array(*near))))
    return rows.withColumns({"block_": F.col("home_") + F.col("step_"), "own_": F.col("step_") == 0}).drop("home_", "step_")


def _done(rows: DataFrame, df: DataFrame, name: str) -> DataFrame:
    return rows.where("own_").select(*(f"`{c}`" for c in df.columns if c != name), F.col("new_").alias(name))


def shift(df: DataFrame, name: str, c: str | Column, n: int = 1, *, order_by: Sequence[str]) -> DataFrame:
    """``df`` with ``name``: the value n rows back (ahead for a negative n); null where there is none."""
    rows = _blocks(df, order_by, max(n, 0), max(-n, 0))
    w = Window.partitionBy("block_").orderBy("place_")
    return _done(rows.withColumn("new_", F.lag(_c(c), n).over(w)), df, name)


def diff(df: DataFrame, name: str, c: str | Column, n: int = 1, *, order_by: Sequence[str]) -> DataFrame:
    """``df`` with ``name``: the value minus the one n rows back (ahead for a negative n), as a double."""
    rows = _blocks(df, order_by, max(n, 0), max(-n, 0))
    x = _c(c).cast("double")
    w = Window.partitionBy("block_").orderBy("place_")
    return _done(rows.withColumn("new_", x - F.lag(x, n).over(w)), df, name)


def rolling_mean(df: DataFrame, name: str, c: str | Column, n: int, *, order_by: Sequence[str]) -> DataFrame:
    """``df`` with ``name``: the mean of the non-null values among the last n rows; null in the first n - 1."""
    if n < 1:
        raise ValueError("rolling_mean needs a positive number of rows")
    rows = _blocks(df, order_by, n - 1)
    w = Window.partitionBy("block_").orderBy("place_").rowsBetween(1 - n, Window.currentRow)
    return _done(rows.withColumn("new_", F.when(F.col("place_") >= n - 1, F.avg(_c(c).cast("double")).over(w))), df, name)


def cum_sum(df: DataFrame, name: str, c: str | Column, *, order_by: Sequence[str]) -> DataFrame:
    """``df`` with ``name``: the running sum as a double; nulls add nothing and stay null."""
    rows = _blocks(df, order_by).withColumn("x_", _c(c).cast("double"))
    totals = rows.groupBy("block_").agg(F.coalesce(F.sum("x_"), F.lit(0.0)).alias("t_"))
    # one row for each block
    before = F.coalesce(F.sum("t_").over(Window.orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    starts = totals.select("block_", before.alias("before_"))
    w = Window.partitionBy("block_").orderBy("place_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = rows.withColumn("within_", F.sum("x_").over(w)).join(starts, "block_")
    return _done(within.withColumn("new_", F.when(F.col("x_").isNotNull(), F.col("before_") + F.col("within_"))), df, name)


def rank(df: DataFrame, name: str, c: str | Column) -> DataFrame:
    """``df`` with ``name``: the ascending rank from 1, ties share their mean rank; null for a null."""
    held = df.withColumn("value_", _c(c))
    # equal values are counted before they are placed, so a frequent one costs no task more than others
    counts = held.where("value_ is not null").groupBy("value_").agg(F.count("*").cast("double").alias("n_"))
    upto = cum_sum(counts, "upto_", "n_", order_by=["value_"]).select(F.col("value_").alias("key_"), (F.col("upto_") - (F.col("n_") - 1) / 2).alias("new_"))
    out = held.join(upto, F.col("value_") == F.col("key_"), "left")
    return out.select(*(f"`{k}`" for k in df.columns if k != name), F.col("new_").alias(name))
