"""A baseline table by arm: sizes, mean (SD) with Welch's p, and counts (%) with a chi-square p."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .special import chi2_cdf
from .ttests import welch_from


def format_p(p: float | None) -> str:
    if p is None or p != p:
        return ""
    return "<0.001" if p < 0.001 else f"{p:.3f}"


def chi_square_p(observed: Sequence[Sequence[int]]) -> float | None:
    """Independence of the rows and columns of a table of counts; null for an empty or one-row table."""
    rows, columns = [sum(r) for r in observed], [sum(c) for c in zip(*observed, strict=True)]
    total = sum(rows)
    if not total or len(rows) < 2:
        return None
    x = sum((observed[i][j] - r * c / total) ** 2 / (r * c / total) for i, r in enumerate(rows) for j, c in enumerate(columns) if r * c > 0)
    return 1 - chi2_cdf(x, (len(rows) - 1) * (len(columns) - 1))


def continuous_stats(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """(arm, variable, n, mean, sd, var) in one aggregation."""
    rows = df.select(F.col(by).alias("arm"), F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x")).select("arm", "x.*")
    return rows.where("v is not null and not isnan(v)").groupBy("arm", "variable").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.var_samp("v").alias("var"))


def categorical_counts(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """(arm, variable, level, n); a null is a level of its own."""
    rows = df.select(F.col(by).alias("arm"), F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), F.coalesce(F.col(c).cast("string"), F.lit("null")).alias("level")) for c in columns))).alias("x"))
    return rows.groupBy("arm", "x.variable", "x.level").agg(F.count("*").alias("n"))


def table_one(df: DataFrame, by: str, continuous: Sequence[str] = (), categorical: Sequence[str] = (), *, digits: int = 1, labels: Mapping[str, str] | None = None) -> DataFrame:
    """The table as a frame (row, characteristic, one column for each arm, p).

    p-values of means compare the first two arms, marked with a dagger where there are more.
    """
    labels = labels or {}
    sizes = {r["arm"]: r["n"] for r in df.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("arm")).agg(F.count("*").alias("n")).collect()}
    arms = sorted(sizes)
    if len(arms) < 2:
        raise ValueError(f"{by} has {len(arms)} level(s); a baseline table compares at least 2")
    out = [("n", *(str(sizes[a]) for a in arms), "")]
    if continuous:
        got = {(r["arm"], r["variable"]): r for r in continuous_stats(df, by, continuous).collect()}
        for c in continuous:
            cells = [got.get((a, c)) for a in arms]
            p = None
            if cells[0] and cells[1] and min(cells[0]["n"], cells[1]["n"]) >= 2:
                p = welch_from(*({"n": x["n"], "m": x["mean"], "v": x["var"]} for x in cells[:2])).p
            fmt = lambda v: "NaN" if v is None else f"{v:.{digits}f}"
            out.append((f"{labels.get(c, c)}, mean (SD)", *(f"{fmt(x['mean'])} ({fmt(x['sd'])})" if x else "NaN (NaN)" for x in cells), format_p(p) + ("†" if len(arms) > 2 else "")))
    if categorical:
        counts = {(r["variable"], r["level"], r["arm"]): r["n"] for r in categorical_counts(df, by, categorical).collect()}
        for c in categorical:
            levels = sorted({lv for v, lv, _ in counts if v == c})
            observed = [[counts.get((c, lv, a), 0) for a in arms] for lv in levels]
            out.append((f"{labels.get(c, c)}, n (%)", *("" for _ in arms), format_p(chi_square_p(observed))))
            out += [(f"   {lv}", *(f"{n} ({100 * n / sizes[a]:.{digits}f}%)" for n, a in zip(row, arms, strict=True)), "") for lv, row in zip(levels, observed, strict=True)]
    schema = ", ".join(["row int", "characteristic string", *(f"`{a}` string" for a in arms), "p string"])
    return df.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(out)], schema)
