"""The time windows of ``operators.timegroup`` over streams, beyond what a batch engine needs.

Fixed, left-closed windows with a period of at least the step: the cases that Spark's own window
function and watermarks cover, so late rows are bounded and state is dropped as the watermark passes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.timegroup import parse_duration


def group_by_dynamic_stream(stream: DataFrame, index: str, every: str, *aggs: Column, period: str | None = None, offset: str | None = None, by: Sequence[str] = (), late: str = "1 hour") -> DataFrame:
    """Aggregates by window start and ``by``; rows later than ``late`` behind the newest are dropped."""
    step, length = parse_duration(every), parse_duration(period or every)
    if step.calendar or length.calendar or length.amount < step.amount:
        raise ValueError("A stream takes fixed windows whose period is at least the step")
    millis = lambda d: f"{int(d.amount)} milliseconds"
    start = f"{int(parse_duration(offset).amount)} milliseconds" if offset else None
    rows = stream.withColumn(index, F.col(index).cast("timestamp")).withWatermark(index, late)
    w = F.window(index, millis(length), millis(step), start)
    return rows.groupBy(w.alias("w_"), *by).agg(*aggs).select(F.col("w_.start").alias(index), *by, *[F.col(c) for c in _names(rows, aggs)])


def _names(df: DataFrame, aggs: Sequence[Column]) -> list[str]:
    return df.sparkSession.createDataFrame([], df.schema).groupBy().agg(*aggs).columns


def to_memory(stream: DataFrame, name: str, mode: str = "append"):
    """A query that keeps its result as a table of the session; for tests and small results."""
    return stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
