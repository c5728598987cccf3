"""Window operations over an explicit order, optionally within keys (nulls are a key of their own).

As column expressions these need keys for large tables: without any, Spark brings all rows to one task.
``operators.ordered`` has the same operations over whole frames of any size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

Order = str | Column | Sequence[str | Column]


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def window(order_by: Order, keys: Sequence[str] = ()) -> WindowSpec:
    order = list(order_by) if isinstance(order_by, (list, tuple)) else [order_by]
    return Window.partitionBy(*keys).orderBy(*order)


def shift(c: str | Column, n: int = 1, *, order_by: Order, keys: Sequence[str] = ()) -> Column:
    """The value n rows back (ahead for a negative n); null where there is none."""
    return F.lag(_c(c), n).over(window(order_by, keys))


def cum_sum(c: str | Column, *, order_by: Order, keys: Sequence[str] = ()) -> Column:
    """Running sum as a double; nulls add nothing and stay null."""
    x = _c(c).cast("double")
    return F.when(x.isNotNull(), F.sum(x).over(window(order_by, keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def diff(c: str | Column, n: int = 1, *, order_by: Order, keys: Sequence[str] = ()) -> Column:
    """Minus the value n rows back (ahead for a negative n)."""
    return _c(c).cast("double") - shift(_c(c).cast("double"), n, order_by=order_by, keys=keys)


def rolling_mean(c: str | Column, n: int, *, order_by: Order, keys: Sequence[str] = ()) -> Column:
    """Mean of the non-null values among the last n rows; null in the first n - 1."""
    if n < 1:
        raise ValueError("rolling_mean needs a positive number of rows")
    w = window(order_by, keys)
    return F.when(F.row_number().over(w) >= n, F.avg(_c(c).cast("double")).over(w.rowsBetween(1 - n, Window.currentRow)))


def rank(c: str | Column, *, keys: Sequence[str] = ()) -> Column:
    """Ascending from 1, ties share their mean rank; null for a null."""
    x = _c(c)
    lower = F.rank().over(Window.partitionBy(*keys, x.isNull()).orderBy(x))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, x))
    return F.when(x.isNotNull(), lower + (ties - 1) / 2)
