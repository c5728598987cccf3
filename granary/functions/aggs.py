"""Aggregates. All skip nulls; those that depend on row order take the ordering column.

They combine freely: ``div(total("a"), total("b"))`` is an aggregate too, with ``exprs.div``'s rules.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total(c: str | Column) -> Column:
    """The sum as a double; 0 of nothing."""
    return F.coalesce(F.sum(_c(c).cast("double")), F.lit(0.0))


def mean(c: str | Column) -> Column:
    return F.avg(_c(c).cast("double"))


def minimum(c: str | Column) -> Column:
    return F.min(_c(c))


def maximum(c: str | Column) -> Column:
    return F.max(_c(c))


def count(c: str | Column) -> Column:
    """Values that are not null."""
    return F.count(_c(c))


def n_unique(c: str | Column) -> Column:
    return F.count_distinct(_c(c))


def first_by(c: str | Column, order_by: str | Column) -> Column:
    """The first non-null value in the order."""
    return F.min_by(_c(c), F.when(_c(c).isNotNull(), _c(order_by)))


def last_by(c: str | Column, order_by: str | Column) -> Column:
    return F.max_by(_c(c), F.when(_c(c).isNotNull(), _c(order_by)))


def quantile(c: str | Column, p: float) -> Column:
    """Exact, interpolated between neighbours at (n - 1) p."""
    return F.percentile(_c(c).cast("double"), F.lit(float(p)))


def median(c: str | Column) -> Column:
    return quantile(c, 0.5)


def std(c: str | Column) -> Column:
    """Sample standard deviation; null under two values."""
    return F.stddev_samp(_c(c).cast("double"))


def var(c: str | Column) -> Column:
    return F.var_samp(_c(c).cast("double"))


def implode(c: str | Column, order_by: str | Column) -> Column:
    """The non-null values as an array, in the order."""
    pair = F.when(_c(c).isNotNull(), F.struct(_c(order_by).alias("o"), _c(c).alias("v")))
    return F.transform(F.sort_array(F.collect_list(pair)), lambda x: x["v"])


def correlation(a: str | Column, b: str | Column) -> Column:
    """Pearson's over rows where both are present; null for under two rows or a constant."""
    x, y = _c(a).cast("double"), _c(b).cast("double")
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def group(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """Groups by at least one key (nulls are one group); names of results must differ."""
    if not keys:
        raise ValueError("groupBy needs at least one key")
    out = df.groupBy(*keys).agg(*aggs)
    if len(set(out.columns)) < len(out.columns):
        raise ValueError(f"Duplicate result names: {out.columns}")
    return out


def group_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return group(df, keys, F.count(F.lit(1)).alias("count"))


def per_group(df: DataFrame, keys: Sequence[str], fn, schema: str) -> DataFrame:
    """``fn(key, pandas frame) -> pandas frame`` of every group, on the executors. A group must fit in memory."""
    return df.groupBy(*keys).applyInPandas(fn, schema)


def groups(df: DataFrame, keys: Sequence[str]) -> Iterator[tuple[dict, DataFrame]]:
    """(key, its rows as a frame) of each group, nulls being one, in order of the keys; for a few groups.

    The keys alone come to the driver, a partition at a time; every frame is a filter of ``df``.
    """
    for r in df.select(*keys).distinct().orderBy(*(F.col(k).asc_nulls_last() for k in keys)).toLocalIterator():
        of = df
        for k in keys:
            of = of.where(F.col(f"`{k}`").eqNullSafe(F.lit(r[k])))
        yield r.asDict(), of


def aggregate(df: DataFrame, *aggs: Column) -> DataFrame:
    """One row for the whole frame."""
    return df.agg(*aggs)
