"""Projection, joins, sorting, distinct, sampling, union and reshaping of DataFrames.

Frames have no order of their own: whatever depends on one takes ``order_by``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import pinned
from ..sources.random import Mulberry

HOW = {"inner": "inner", "left": "left", "right": "right", "outer": "full"}


def _need(df: DataFrame, names: Sequence[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"No column {', '.join(missing)}; there are {', '.join(df.columns)}")


# -- projection


def select(df: DataFrame, *items: str | Column) -> DataFrame:
    """Columns; of several with one name the last stays."""
    out = df.select(*items)
    if len(set(out.columns)) == len(out.columns):
        return out
    keep = {name: i for i, name in enumerate(out.columns)}
    return out.toDF(*(f"c{i}" for i in range(len(out.columns)))).select(*(F.col(f"c{i}").alias(n) for n, i in keep.items()))


def select_aggregates(df: DataFrame, *aggs: Column) -> DataFrame:
    """All items aggregate: one row."""
    return df.agg(*aggs)


def with_aggregates(df: DataFrame, **aggs: Column) -> DataFrame:
    """Each row with whole-frame aggregates beside it: one partial aggregation and a one-row broadcast."""
    one = df.agg(*(a.alias(n) for n, a in aggs.items()))
    return df.drop(*aggs).join(F.broadcast(one))


def with_columns(df: DataFrame, **columns) -> DataFrame:
    """Adds or replaces columns; all are computed from the input, also from what is replaced."""
    for n, c in columns.items():
        if callable(c) and not isinstance(c, Column):
            raise TypeError(f"{n} is a function; give a Column, or use map_values")
    return df.withColumns({n: c if isinstance(c, Column) else F.lit(c) for n, c in columns.items()})


def where(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is true; it must be boolean."""
    kind = df.select(condition.alias("c")).schema["c"].dataType.simpleString()
    if kind != "boolean":
        raise TypeError(f"A filter takes a boolean, not {kind}")
    return df.filter(condition)


def where_rows(df: DataFrame, keep) -> DataFrame:
    """Rows for which ``keep(dict)`` is true, in Arrow batches; for what expressions cannot say."""

    def run(frames):
        for pdf in frames:
            yield pdf[[bool(keep(r)) for r in pdf.to_dict("records")]]

    return df.mapInPandas(run, df.schema)


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Unknown names do not matter; of several columns that get one name the last stays."""
    target = [names.get(c, c) for c in df.columns]
    keep = {n: i for i, n in enumerate(target)}
    return df.select(*(F.col(f"`{df.columns[i]}`").alias(n) for n, i in keep.items()))


def drop(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def drop_nulls(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows without a null in the subset; NaN is a value."""
    names = list(subset) if subset else df.columns
    _need(df, names)
    return df.filter(reduce(lambda a, b: a & b, (F.col(f"`{n}`").isNotNull() for n in names)))


# -- joins


def join(left: DataFrame, right: DataFrame, on: str | Sequence[str] | None = None, *, left_on: str | Sequence[str] | None = None, right_on: str | Sequence[str] | None = None, how: str = "inner", suffix: str = "_right") -> DataFrame:
    """Equality join on one key or several; null keys never match.

    All left columns, then the right ones without shared keys; names that clash get the suffix. Right and
    outer joins fill the left-named key from the right. With different key names the right key stays.
    A side whose unmatched rows stay is read twice, for its rows with and without a whole key, so it must not be random.
    """
    if how not in HOW:
        raise ValueError(f"how must be one of {', '.join(HOW)}")
    listed = lambda x: [x] if isinstance(x, str) else list(x or ())
    lk, rk = (listed(on), listed(on)) if on is not None else (listed(left_on), listed(right_on))
    if not lk or len(lk) != len(rk):
        raise ValueError("Give on, or left_on and right_on of one length")
    _need(left, lk)
    _need(right, rk)
    for a, b in zip(lk, rk, strict=True):
        ka, kb = left.schema[a].dataType, right.schema[b].dataType
        if (ka.simpleString() == "string") != (kb.simpleString() == "string"):
            raise TypeError(f"Keys of different kinds: {a} is {ka.simpleString()}, {b} is {kb.simpleString()}")
    l, r = left.alias("l"), right.alias("r")
    col = lambda side, name: F.col(f"{side}.`{name}`")
    match = reduce(lambda x, y: x & y, (col("l", a) == col("r", b) for a, b in zip(lk, rk, strict=True)))
    whole = lambda side, names: reduce(lambda x, y: x & y, (col(side, n).isNotNull() for n in names))
    full_l, full_r = whole("l", lk), whole("r", rk)
    joined = l.where(full_l).join(r.where(full_r), match, HOW[how])
    shared = dict(zip(lk, rk, strict=True))
    fill = how in ("right", "outer")
    out = [F.coalesce(col("l", c), col("r", shared[c])).alias(c) if fill and c in shared else col("l", c).alias(c) for c in left.columns]
    gone = {b for a, b in shared.items() if a == b}
    taken = set(left.columns)
    for c in right.columns:
        if c in gone:
            continue
        name = c
        while name in taken:
            name += suffix
        taken.add(name)
        out.append(col("r", c).alias(name))
    # rows without a whole key match nothing: they pass by the join, whose shuffle would bring all to one task
    parts = [joined.select(*out)]
    if how in ("left", "outer") and any(left.schema[c].nullable for c in lk):
        parts.append(l.where(~full_l).join(r.limit(0), F.lit(True), "left").select(*out))
    if how in ("right", "outer") and any(right.schema[c].nullable for c in rk):
        parts.append(l.limit(0).join(r.where(~full_r), F.lit(True), "right").select(*out))
    return reduce(lambda x, y: x.union(y), parts)


# -- order and limits


def _orders(by: str | Sequence[str], descending: bool | Sequence[bool]) -> list[Column]:
    by = [by] if isinstance(by, str) else list(by)
    down = [descending] * len(by) if isinstance(descending, bool) else list(descending)
    if len(down) != len(by):
        raise ValueError("descending needs one flag for each key")
    return [F.col(c).desc_nulls_last() if d else F.col(c).asc_nulls_last() for c, d in zip(by, down, strict=True)]


def sort(df: DataFrame, by: str | Sequence[str], descending: bool | Sequence[bool] = False, tie: Sequence[str | Column] = ()) -> DataFrame:
    """By several keys, each in its direction, nulls last in both; ``tie`` orders equal rows."""
    return df.orderBy(*_orders(by, descending), *tie)


def head(df: DataFrame, n: int = 5, *, order_by: Sequence[str | Column]) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


def tail(df: DataFrame, n: int = 5, *, order_by: Sequence[str]) -> DataFrame:
    """The last n rows, in order."""
    return df.orderBy(*(F.col(c).desc_nulls_last() for c in order_by)).limit(n).orderBy(*(F.col(c).asc_nulls_first() for c in order_by))


def top_k(df: DataFrame, k: int, by: str | Sequence[str], descending: bool | Sequence[bool] = True, tie: Sequence[str | Column] = ()) -> DataFrame:
    return sort(df, by, descending, tie).limit(k)


def slice_rows(df: DataFrame, start: int = 0, end: int | None = None, *, order_by: Sequence[str]) -> DataFrame:
    """Rows start to before end in the order; negative places count from the end."""
    n = df.count() if start < 0 or (end is not None and end < 0) else None
    place = lambda x: x if x >= 0 else max(0, n + x)
    a = place(start)
    out = df.orderBy(*(F.col(c).asc_nulls_last() for c in order_by)).offset(a)
    return out if end is None else out.limit(max(0, place(end) - a))


def unique(df: DataFrame, subset: Sequence[str] | None = None, *, order_by: Sequence[str | Column] | None = None) -> DataFrame:
    """The first row in the order of each distinct key; nulls are equal. All columns: plain distinct rows."""
    if not subset:
        return df.distinct()
    _need(df, subset)
    if not order_by:
        raise ValueError("unique of a subset needs order_by")
    order = F.struct(*(F.col(c) if isinstance(c, str) else c for c in order_by))
    # min_by combines before the shuffle, where a window would move whole rows of a hot key to one task
    return df.groupBy(*subset).agg(F.min_by(F.struct(*df.columns), order).alias("row")).select("row.*")


def sample(df: DataFrame, n: int, *, seed: int, order_by: Sequence[str], with_replacement: bool = False) -> DataFrame:
    """Exactly n rows: places drawn by a seeded generator meet the rows' places in the order."""
    height = df.count()
    if n > height and not with_replacement:
        raise ValueError(f"Cannot draw {n} of {height} rows without replacement")
    places = Mulberry(seed).places(n, height, with_replacement)
    spark = df.sparkSession
    drawn = spark.createDataFrame([(p, i) for i, p in enumerate(places)], "place_ long, draw_ long")
    return numbered(df, order_by, "place_").join(drawn, "place_").orderBy("draw_").drop("place_", "draw_")


def numbered(df: DataFrame, order_by: Sequence[str], name: str) -> DataFrame:
    """``df`` with its row number from 0 in the order, without bringing the rows to one task.

    Range partitions are sorted, numbered and written once; each then adds the rows of those before it.
    """
    order = [F.col(c).asc_nulls_last() for c in order_by]
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"part_": F.spark_partition_id(), "at_": F.monotonically_increasing_id()})
    placed = pinned(placed)  # computed twice, the partitions could differ
    sizes = placed.groupBy("part_").agg(F.count("*").alias("n_"), F.min("at_").alias("first_"))
    before = F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    return placed.join(sizes.select("part_", (before - F.col("first_")).alias("shift_")), "part_").withColumn(name, F.col("at_") + F.col("shift_")).drop("part_", "at_", "shift_")


def sample_approximate(df: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows at random when replay of a sequence does not matter: one top-n pass."""
    return df.orderBy(F.rand(seed)).limit(n)


# -- union and reshaping


def concat(*frames: DataFrame) -> DataFrame:
    """All rows, aligned by name; missing columns are null, columns of mixed kinds become strings."""
    kinds: dict[str, set[str]] = {}
    for f in frames:
        for n, t in f.dtypes:
            kinds.setdefault(n, set()).add(t)
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    text = {n for n, t in kinds.items() if len(t) > 1 and not t <= numeric}
    fixed = [f.withColumns({n: F.col(n).cast("string") for n in f.columns if n in text}) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), fixed)


_PIVOT = {"sum": lambda c: F.sum(c.cast("double")), "mean": lambda c: F.avg(c.cast("double")), "min": F.min, "max": F.max, "count": F.count}


def pivot(df: DataFrame, index: str | Sequence[str], columns: str, values: str, agg: str = "first", *, labels: Sequence | None = None, order_by: str | None = None, max_labels: int = 10_000) -> DataFrame:
    """One row for each index, one column for each label in order of first appearance.

    ``labels`` fixes the columns and saves a pass. A null label makes no column but its row stays; a
    missing cell is null. ``first``, and the order of labels, follow ``order_by``.
    """
    index = [index] if isinstance(index, str) else list(index)
    if agg not in (*_PIVOT, "first"):
        raise ValueError(f"agg must be one of first, {', '.join(_PIVOT)}")
    if (agg == "first" or labels is None) and order_by is None:
        raise ValueError("pivot needs order_by here")
    if labels is None:
        found = df.where(F.col(columns).isNotNull()).groupBy(columns).agg(F.min(order_by).alias("o")).orderBy("o").limit(max_labels + 1).collect()
        if len(found) > max_labels:
            raise ValueError(f"More than {max_labels} labels")
        labels = [r[0] for r in found]
    v = F.col(values)
    cell = (lambda c: F.min_by(c, F.when(c.isNotNull(), F.col(order_by)))) if agg == "first" else _PIVOT[agg]

    def one(label) -> Column:
        x = cell(F.when(F.col(columns) == F.lit(label), v))
        return (F.nullif(x, F.lit(0)) if agg == "count" else x).alias(str(label))

    return df.groupBy(*index).agg(*(one(x) for x in labels)) if labels else df.select(*index).distinct()


def melt(df: DataFrame, id_vars: Sequence[str], value_vars: Sequence[str] | None = None, variable_name: str = "variable", value_name: str = "value") -> DataFrame:
    """One row for each value; nulls stay, mixed kinds become strings."""
    value_vars = list(value_vars) if value_vars else [c for c in df.columns if c not in id_vars]
    _need(df, [*id_vars, *value_vars])
    kinds = {t for n, t in df.dtypes if n in value_vars}
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    to = None if len(kinds) == 1 else "double" if kinds <= numeric else "string"
    if to:
        df = df.withColumns({n: F.col(n).cast(to) for n in value_vars})
    return df.unpivot(list(id_vars), value_vars, variable_name, value_name)
