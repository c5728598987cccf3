"""t-tests on columns: Spark gathers count, mean and variance, the rest is arithmetic."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from .special import t_two_sided_p


@dataclass(frozen=True)
class TTest:
    t: float
    df: float
    p: float
    difference: float
    means: tuple[float, ...]
    ns: tuple[int, ...]


def _numeric(df: DataFrame, column: str) -> None:
    if not isinstance(df.schema[column].dataType, (NumericType, BooleanType)):
        raise TypeError(f"{column} is not numeric")


def _ratio(difference: float, se: float) -> float:
    return difference / se if se > 0 else math.copysign(math.inf, difference) if difference else math.nan


def one_sample(df: DataFrame, column: str, mu: float = 0.0) -> TTest:
    """Against a fixed mean; nulls do not count."""
    _numeric(df, column)
    x = F.col(column).cast("double")
    r = df.agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.stddev_samp(x).alias("s")).first()
    if r["n"] < 2:
        raise ValueError("A t-test needs at least 2 values")
    t = _ratio(r["m"] - mu, r["s"] / math.sqrt(r["n"]))
    return TTest(t, r["n"] - 1, t_two_sided_p(t, r["n"] - 1), r["m"] - mu, (r["m"],), (r["n"],))


def _two(df: DataFrame, column: str, group: str, first, second):
    _numeric(df, column)
    x = F.col(column).cast("double")
    got = {r[group]: r for r in df.where(F.col(group).isin(first, second)).groupBy(group).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.var_samp(x).alias("v")).collect()}
    if any(g not in got or got[g]["n"] < 2 for g in (first, second)):
        raise ValueError("Each group needs at least 2 values")
    return got[first], got[second]


def two_sample(df: DataFrame, column: str, group: str, first, second) -> TTest:
    """Pooled variance; nulls do not count."""
    a, b = _two(df, column, group, first, second)
    freedom = a["n"] + b["n"] - 2
    pooled = ((a["n"] - 1) * a["v"] + (b["n"] - 1) * b["v"]) / freedom
    t = _ratio(a["m"] - b["m"], math.sqrt(pooled * (1 / a["n"] + 1 / b["n"])))
    return TTest(t, freedom, t_two_sided_p(t, freedom), a["m"] - b["m"], (a["m"], b["m"]), (a["n"], b["n"]))


def welch(df: DataFrame, column: str, group: str, first, second) -> TTest:
    """Own variances; nulls do not count."""
    return welch_from(*_two(df, column, group, first, second))


def welch_from(a, b) -> TTest:
    va, vb = a["v"] / a["n"], b["v"] / b["n"]
    t = _ratio(a["m"] - b["m"], math.sqrt(va + vb))
    spread = va**2 / (a["n"] - 1) + vb**2 / (b["n"] - 1)
    freedom = (va + vb) ** 2 / spread if spread > 0 else float(a["n"] + b["n"] - 2)
    return TTest(t, freedom, t_two_sided_p(t, freedom), a["m"] - b["m"], (a["m"], b["m"]), (a["n"], b["n"]))
