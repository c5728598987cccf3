"""Grouping by time windows: tumbling, sliding or gapped, of fixed or calendar length.

A row's windows are an array of starts made by arithmetic on its own value, exploded and grouped; there
is no join with a table of windows. Fixed windows align to the Unix epoch, calendar ones to the first
of a month, both in UTC.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, StringType, TimestampNTZType, TimestampType

# Milliseconds and months of the units.
FIXED_UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}
CALENDAR_UNITS = {"mo": 1, "q": 3, "y": 12}

_EDGES = {
    "left": lambda t, a, b: (t >= a) & (t < b),
    "right": lambda t, a, b: (t > a) & (t <= b),
    "both": lambda t, a, b: (t >= a) & (t <= b),
    "none": lambda t, a, b: (t > a) & (t < b),
}


@dataclass(frozen=True)
class Duration:
    """So many months, or so many milliseconds (plain numbers for a numeric index)."""

    amount: float
    calendar: bool = False


def parse_duration(spec: str | float | Duration) -> Duration:
    """A number, or a number and a unit: ms s m h d w, or in whole steps mo q y."""
    if isinstance(spec, Duration):
        return spec
    if isinstance(spec, (int, float)):
        return Duration(float(spec))
    m = re.fullmatch(r"\s*(-?\d+(?:\.\d+)?)\s*(ms|mo|s|m|h|d|w|q|y)\s*", spec)
    if not m:
        raise ValueError(f"Cannot read the duration {spec!r}")
    n, unit = float(m[1]), m[2]
    if unit in FIXED_UNITS:
        return Duration(n * FIXED_UNITS[unit])
    if n != int(n):
        raise ValueError(f"Calendar durations are whole: {spec!r}")
    return Duration(n * CALENDAR_UNITS[unit], True)


def _floor_div(a: Column, every: int) -> Column:
    """Floor of a / every; the quotient is whole, so a double holds it exactly below 2**53."""
    return ((a - F.pmod(a, F.lit(every).cast("bigint"))) / F.lit(every)).cast("bigint")


def _whole(x: float, what: str) -> int:
    if x != int(x):
        raise ValueError(f"{what} is finer than the index can hold")
    return int(x)


def window_starts(c: Column, every, period=None, offset=0, closed: str = "left", numeric: bool = False) -> Column:
    """An array of the starts of all windows that hold the value; null for a null."""
    if closed not in _EDGES:
        raise ValueError(f"closed must be one of {', '.join(_EDGES)}")
    every = parse_duration(every)
    period = every if period is None else parse_duration(period)
    offset = parse_duration(offset)
    if every.calendar != period.calendar:
        raise ValueError("every and period must both be fixed or both be calendar durations")
    if every.amount <= 0 or period.amount <= 0:
        raise ValueError("every and period must be positive")
    shift = offset.amount if offset.calendar == every.calendar else 0.0
    inside = _EDGES[closed]
    if every.calendar:
        if numeric:
            raise ValueError("Calendar windows need a date index")
        step, length, off = int(every.amount), int(period.amount), int(shift)
        month = ((F.year(c) - 1970) * 12 + F.month(c) - 1 - off).cast("bigint")
        at = lambda m: F.add_months(F.lit("1970-01-01").cast("date"), m.cast("int")).cast("timestamp_ntz")
        # a value on a closed right edge also belongs to the window before
        ks = F.sequence(_floor_div(month - length, step), _floor_div(month, step) + 1)
        starts = F.transform(ks, lambda k: k * step + off)
        t = c.cast("timestamp_ntz")
        return F.transform(F.filter(starts, lambda m: inside(t, at(m), at(m + length))), at)
    if numeric and any(x != int(x) for x in (every.amount, period.amount, shift)):
        t, step, length, off = c.cast("double"), every.amount, period.amount, shift
        ks = F.sequence(F.floor((t - off - length) / step), F.floor((t - off) / step) + 1)
        return F.filter(F.transform(ks, lambda k: k * step + off), lambda a: inside(t, a, a + length))
    scale = 1 if numeric else 1000
    step, length, off = (_whole(x * scale, "the window") for x in (every.amount, period.amount, shift))
    t = c if numeric else F.unix_micros(c.cast("timestamp"))
    low = (F.floor(t) if numeric else t).cast("bigint")
    ks = F.sequence(_floor_div(low - off - length, step), _floor_div(low - off, step) + 1)
    found = F.filter(F.transform(ks, lambda k: k * step + off), lambda a: inside(t, a, a + length))
    return F.transform(found, lambda a: a.cast("double")) if numeric else F.transform(found, lambda a: F.timestamp_micros(a).cast("timestamp_ntz"))


def assign_windows(df: DataFrame, index: str, every, period=None, offset=0, closed: str = "left") -> DataFrame:
    """``df`` with the index replaced by a window's start, a row for each window; null indexes go."""
    kind = df.schema[index].dataType
    if isinstance(kind, StringType):
        raise TypeError(f"{index} is a string; cast it to a date first")
    if not isinstance(kind, (NumericType, DateType, TimestampType, TimestampNTZType)):
        raise TypeError(f"{index} cannot be an index of windows")
    starts = window_starts(F.col(index), every, period, offset, closed, isinstance(kind, NumericType))
    return df.where(F.col(index).isNotNull()).withColumn(index, F.explode(starts))


def group_by_dynamic(df: DataFrame, index: str, every, *aggs: Column, period=None, offset=0, closed: str = "left", by: Sequence[str] = ()) -> DataFrame:
    """Aggregates by window start and ``by``, in order of the start."""
    return assign_windows(df, index, every, period, offset, closed).groupBy(index, *by).agg(*aggs).orderBy(index, *by)
