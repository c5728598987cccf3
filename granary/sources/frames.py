"""Frames from Python data, and what a frame is made of."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from datetime import date, datetime
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import type_of

_INT_MAX = 2**31 - 1


def infer_type(values: Sequence[Any]) -> str:
    """The Spark type for some values: nulls and NaN do not count, mixed kinds are strings."""
    seen = {_kind(v) for v in values if v is not None and v == v}
    if not seen:
        return "double"
    if seen <= {"int", "double"}:
        return "int" if seen == {"int"} else "double"
    return seen.pop() if len(seen) == 1 else "string"


def _kind(v: Any) -> str:
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "int" if float(v).is_integer() and abs(v) <= _INT_MAX else "double"
    return "timestamp_ntz" if isinstance(v, (date, datetime)) else "string"


def convert(v: Any, to: str) -> Any:
    """A Python value as one of a Spark type; null where it does not convert, NaN is null."""
    if v is None or v != v:
        return None
    try:
        if to == "double":
            return float(v)
        if to == "int":
            whole = int(float(v))
            return whole if abs(whole) <= _INT_MAX else None
        if to == "boolean":
            return v if isinstance(v, bool) else {"true": True, "false": False}.get(str(v).lower(), bool(v) if isinstance(v, (int, float)) else None)
        if to == "timestamp_ntz":
            if isinstance(v, (int, float)):
                return datetime.fromtimestamp(v / 1000, tz=None)
            return v if isinstance(v, datetime) else datetime(v.year, v.month, v.day) if isinstance(v, date) else datetime.fromisoformat(str(v))
        return v if isinstance(v, str) else str(v)
    except (TypeError, ValueError, OverflowError):
        return None


def from_columns(spark: SparkSession, columns: Mapping[str, Sequence[Any]], dtypes: Mapping[str, str] | None = None) -> DataFrame:
    """Columns of one length; types are given by name or inferred from the values."""
    lengths = {len(v) for v in columns.values()}
    if len(lengths) > 1:
        raise ValueError("Columns must all have one length (the frame is not rectangular)")
    kinds = {n: type_of((dtypes or {})[n]) if n in (dtypes or {}) else infer_type(v) for n, v in columns.items()}
    schema = ", ".join(f"`{n}` {t}" for n, t in kinds.items())
    rows = zip(*([convert(x, kinds[n]) for x in v] for n, v in columns.items()), strict=True) if columns else []
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def from_rows(spark: SparkSession, rows: Sequence[Mapping[str, Any]], dtypes: Mapping[str, str] | None = None) -> DataFrame:
    """Rows as mappings; the first names the columns, keys missing elsewhere are null."""
    names = list(rows[0]) if rows else list(dtypes or {})
    return from_columns(spark, {n: [r.get(n) for r in rows] for n in names}, dtypes)


def column(spark: SparkSession, values: Sequence[Any], dtype: str | None = None, name: str = "value") -> DataFrame:
    """A frame of one column."""
    return from_columns(spark, {name: values}, {name: dtype} if dtype else None)


def to_rows(df: DataFrame) -> list[dict]:
    """All rows on the driver; for small results."""
    return [r.asDict() for r in df.collect()]


def to_columns(df: DataFrame) -> dict[str, list]:
    return df.toArrow().to_pydict()


def iterate(df: DataFrame) -> Iterator[dict]:
    """Rows one after the other, a partition on the driver at a time."""
    return (r.asDict() for r in df.toLocalIterator(prefetchPartitions=True))


def row(df: DataFrame, i: int, *, order_by: Sequence[str | Column]) -> dict | None:
    """The row at a place in the order, counted from 0."""
    got: list[Row] = df.orderBy(*order_by).offset(i).limit(1).collect()
    return got[0].asDict() if got else None


def shape(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)


def get_column(df: DataFrame, name: str) -> DataFrame:
    if name not in df.columns:
        raise ValueError(f"No column {name}; there are {', '.join(df.columns)}")
    return df.select(name)


def values(df: DataFrame, name: str, *, order_by: Sequence[str | Column], valid_only: bool = False) -> list:
    """A column's values in the order, on the driver; for small results."""
    out = [r[0] for r in df.orderBy(*order_by).select(name).collect()]
    return [v for v in out if v is not None] if valid_only else out


def take(df: DataFrame, places: Sequence[int], *, order_by: Sequence[str]) -> DataFrame:
    """The rows at the places in the order, counted from 0; a repeated place gives its row again, one out of range none."""
    from ..operators.relational import numbered

    wanted = df.sparkSession.createDataFrame([(int(p),) for p in places], "wanted_ long")
    return numbered(df, order_by, "place_").join(wanted, F.col("place_") == F.col("wanted_")).drop("place_", "wanted_")


def is_valid(df: DataFrame, name: str) -> DataFrame:
    """``df`` with ``valid``: whether the column has a value (neither null nor NaN)."""
    c = F.col(f"`{name}`")
    return df.withColumn("valid", c.isNotNull() & ~F.isnan(c) if df.schema[name].dataType.simpleString() in ("double", "float") else c.isNotNull())


def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls) of every column in one pass."""
    return df.agg(F.array(*(F.struct(F.lit(c).alias("column"), F.count_if(F.col(f"`{c}`").isNull()).alias("nulls")) for c in df.columns)).alias("x")).select(F.inline("x"))
