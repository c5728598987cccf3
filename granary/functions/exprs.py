"""Column builders with the engine's null, NaN and division rules; all are plain Catalyst expressions.

Arithmetic works on doubles; a null operand gives null. Session settings do not matter: what ANSI mode
would reject (division by zero, failed casts) is guarded in the expressions themselves.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from datetime import date, datetime
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")

# Accepted type names, by Spark type.
TYPE_NAMES = {
    "double": ("f64", "float", "double", "number"),
    "int": ("i32", "int", "integer"),
    "boolean": ("bool", "boolean"),
    "string": ("str", "string", "text", "varchar"),
    "timestamp_ntz": ("date", "datetime"),
}


def type_of(name: str) -> str:
    """The Spark type that a type name stands for."""
    for spark_type, names in TYPE_NAMES.items():
        if name.lower() in names:
            return spark_type
    raise ValueError(f"Unknown type {name!r}; known: {', '.join(n for names in TYPE_NAMES.values() for n in names)}")


def as_column(x: Any) -> Column:
    """Columns as they are, numbers as double literals, everything else as a literal."""
    if isinstance(x, Column):
        return x
    if isinstance(x, bool) or not isinstance(x, (int, float)):
        return F.lit(x)
    return F.lit(float(x))


def number(x: Any) -> Column:
    """A double; timestamps count as milliseconds since the epoch only through ``epoch_millis``."""
    return as_column(x).cast("double")


def epoch_millis(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")) / F.lit(1000.0)


def apply(name: str, build: Callable[[Column], Column], alias: str | None = None) -> Column:
    """``build`` of a column under its own name, unless another is given."""
    return build(F.col(name)).alias(alias or name)


# -- arithmetic


def add(a: Any, b: Any) -> Column:
    return number(a) + number(b)


def sub(a: Any, b: Any) -> Column:
    return number(a) - number(b)


def mul(a: Any, b: Any) -> Column:
    return number(a) * number(b)


def div(a: Any, b: Any) -> Column:
    """x / 0 is an infinity of x's sign, 0 / 0 and NaN / 0 are NaN."""
    a, b = number(a), number(b)
    by_zero = F.when(a.isNull(), F.lit(None).cast("double")).when(F.isnan(a) | (a == 0), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def mod(a: Any, b: Any) -> Column:
    """The remainder takes the dividend's sign; x % 0 is NaN."""
    a, b = number(a), number(b)
    return F.when((b == 0) & a.isNotNull(), F.lit(NAN)).otherwise(F.try_mod(a, b))


def power(a: Any, b: Any) -> Column:
    return F.pow(number(a), number(b))


def neg(a: Any) -> Column:
    return -number(a)


def absolute(a: Any) -> Column:
    return F.abs(number(a))


def exp(a: Any) -> Column:
    return F.exp(number(a))


def sqrt(a: Any) -> Column:
    return F.sqrt(number(a))


def log(a: Any) -> Column:
    """Natural; log 0 is minus infinity, of a negative number NaN."""
    a = number(a)
    return F.coalesce(F.nanvl(_ln(a), F.ln(a)), F.when(a == 0, F.lit(-INF)).when(a.isNotNull(), F.lit(NAN))).alias("ln")


def _ln(a: Column) -> Column:
    """ln of positive normal numbers to 0.51 units in the last place, as SQL engines have it (Spark's: to 1); NaN or null else.

    a = m 2**k and ln m = 2 artanh(f / (2 + f)) with f = m - 1; whatever the first term loses goes into the small rest.
    The subexpressions repeat, and Catalyst evaluates each once as long as no CASE stands around them.
    """
    k = F.rint(F.log2(a))
    f = a * F.pow(F.lit(2.0), -k) - 1
    high = f + 2
    low = f - (high - 2)
    s = f / high
    cut = lambda x: x * 134217729.0 - (x * 134217729.0 - x)  # the upper 26 bits
    p, s1, h1 = s * high, cut(s), cut(high)
    s2, h2 = s - s1, high - h1
    lost = (f - p - (((s1 * h1 - p) + s1 * h2 + s2 * h1) + s2 * h2) - s * low) / high
    z = s * s
    series = F.lit(2 / 25)
    for n in range(23, 1, -2):
        series = series * z + 2 / n
    whole, first = k * float.fromhex("0x1.62e42feep-1"), s * 2
    total = whole + first
    return total + (((whole - total) + first) + (lost * 2 + k * float.fromhex("0x1.a39ef35793c76p-33") + s * z * series))


def round_half_up(a: Any, digits: int = 0) -> Column:
    """Halves go towards plus infinity."""
    x, f = number(a), float(10**digits)
    whole = F.isnan(x) | (F.abs(x * f) >= 2.0**52)
    return F.when(whole, x).otherwise(F.floor(x * f + 0.5).cast("double") / f)


# -- comparison and logic


def _compare(op: Callable[[Column, Column], Column]) -> Callable[[Any, Any], Column]:
    return lambda a, b: op(as_column(a), as_column(b))


gt, gte, lt, lte = (_compare(op) for op in (lambda a, b: a > b, lambda a, b: a >= b, lambda a, b: a < b, lambda a, b: a <= b))
eq, neq = _compare(lambda a, b: a == b), _compare(lambda a, b: a != b)


def both(a: Column, b: Column) -> Column:
    """AND that is null when either side is, also beside a false."""
    return F.when(a.isNotNull() & b.isNotNull(), a & b)


def either(a: Column, b: Column) -> Column:
    """OR that is null when either side is, also beside a true."""
    return F.when(a.isNotNull() & b.isNotNull(), a | b)


def negate(a: Column) -> Column:
    return ~a


def is_null(a: Column) -> Column:
    return a.isNull()


def is_not_null(a: Column) -> Column:
    return a.isNotNull()


def is_in(c: Column, values: Sequence[Any]) -> Column:
    """False, not null, for a null."""
    return F.coalesce(c.isin(*values), F.lit(False)) if len(values) else F.lit(False)


def between(c: Column, low: float | date | datetime, high: float | date | datetime) -> Column:
    """Both ends included; bounds are numbers or dates."""
    if any(isinstance(x, (str, Column)) for x in (low, high)):
        raise TypeError("between takes numbers or dates as bounds")
    return c.between(as_column(low), as_column(high))


def fill_null(c: Column, value: Any) -> Column:
    return F.coalesce(c, value if isinstance(value, Column) else F.lit(value))


def when(condition: Column, then: Any, otherwise: Any) -> Column:
    """A null condition takes the other branch."""
    wrap = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(condition, wrap(then)).otherwise(wrap(otherwise))


def cast(c: Column, to: str) -> Column:
    """Null where the value does not convert; numbers become ints by truncation, texts by way of a double."""
    kind = type_of(to)
    if kind == "int":
        return c.try_cast("double").try_cast("int")
    return c.try_cast(kind)


# -- strings


def str_lower(c: Column) -> Column:
    return F.lower(c)


def str_upper(c: Column) -> Column:
    return F.upper(c)


def str_len(c: Column) -> Column:
    """UTF-16 code units, as a double."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("double")


def str_contains(c: Column, part: str | re.Pattern) -> Column:
    """A substring, or a match of a compiled pattern; false for a null."""
    return F.coalesce(c.rlike(_java(part)) if isinstance(part, re.Pattern) else c.contains(part), F.lit(False))


def str_starts_with(c: Column, part: str) -> Column:
    return F.coalesce(c.startswith(part), F.lit(False))


def str_ends_with(c: Column, part: str) -> Column:
    return F.coalesce(c.endswith(part), F.lit(False))


def str_replace(c: Column, search: str | re.Pattern, to: str) -> Column:
    """Every occurrence."""
    if isinstance(search, re.Pattern):
        return F.regexp_replace(c, _java(search), to)
    return F.replace(c, F.lit(search), F.lit(to)) if search else c


def str_strip(c: Column) -> Column:
    """All Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", "")


def str_slice(c: Column, start: int, end: int | None = None) -> Column:
    """From start to before end, counted from 0; negative places count from the end."""
    n = F.length(c)
    place = lambda x: F.least(F.lit(x), n) if x >= 0 else F.greatest(n + x, F.lit(0))
    a, b = place(start), n if end is None else place(end)
    return F.substring(c, a + 1, F.greatest(b - a, F.lit(0)))


def _java(p: re.Pattern) -> str:
    flags = "".join(f for f, on in (("i", re.IGNORECASE), ("m", re.MULTILINE), ("s", re.DOTALL)) if p.flags & on)
    return f"(?{flags}){p.pattern}" if flags else p.pattern


# -- dates


def dt_year(c: Column) -> Column:
    return F.year(c).cast("double")


def dt_month(c: Column) -> Column:
    return F.month(c).cast("double")


def dt_day(c: Column) -> Column:
    return F.dayofmonth(c).cast("double")


def dt_hour(c: Column) -> Column:
    return F.hour(c).cast("double")


def dt_weekday(c: Column) -> Column:
    """0 is Sunday."""
    return (F.dayofweek(c) - 1).cast("double")


def map_values(c: Column, fn: Callable[[Any], Any], to: str = "double") -> Column:
    """``fn`` of each value, nulls included, in Arrow batches. For what no built-in function expresses."""
    import pandas as pd

    kind = type_of(to) if to.lower() in {n for names in TYPE_NAMES.values() for n in names} else to

    def run(values):
        return pd.Series([fn(None if x is None or x is pd.NaT or x != x else x) for x in values.astype(object)], dtype=object)

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, kind)(c)
