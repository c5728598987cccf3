"""Ordinary least squares from sufficient statistics that Spark sums up.

One aggregation gives X'X and X'y, a second one the residuals' part of the covariance; only k x k
numbers reach the driver. Rows with a null in a used column are dropped and counted.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .matrix import inv
from .special import f_cdf, t_two_sided_p

Z95 = 1.96


@dataclass
class Fit:
    """A fitted linear model; ci are 95 % intervals from the normal quantile, p-values from Student's t."""

    terms: list[str]
    beta: np.ndarray
    se: np.ndarray
    cov: np.ndarray
    n: int
    df: int
    rss: float
    r2: float
    vcov: str
    n_dropped: int = 0
    n_clusters: int | None = None
    t: np.ndarray = field(init=False)
    p: np.ndarray = field(init=False)
    ci: list[tuple[float, float]] = field(init=False)

    def __post_init__(self):
        with np.errstate(divide="ignore", invalid="ignore"):
            self.t = self.beta / self.se
        self.p = np.array([t_two_sided_p(float(t), self.df) if t == t else math.nan for t in self.t])
        self.ci = [(b - Z95 * s, b + Z95 * s) for b, s in zip(self.beta.tolist(), self.se.tolist(), strict=True)]

    def to_dataframe(self, spark) -> DataFrame:
        rows = [(n, float(b), float(s), float(t), float(p), float(lo), float(hi)) for n, b, s, t, p, (lo, hi) in zip(self.terms, self.beta, self.se, self.t, self.p, self.ci, strict=True)]
        return spark.createDataFrame(rows, "term string, estimate double, se double, t double, p double, ci_low double, ci_high double")


def _total(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def fit_ols(df: DataFrame, y: str | Column, x: dict[str, Column], *, vcov: str = "hc1", cluster: str | Column | None = None, least_pivot: float = 1e-11) -> Fit:
    """Regress y on the terms of ``x`` (name to column, an intercept being ``F.lit(1.0)``).

    vcov: ``classical``, ``hc1`` (scaled by n / (n - k)) or ``cluster`` (G / (G - 1) * (n - 1) / (n - k),
    with G - 1 degrees of freedom).
    """
    if vcov not in ("classical", "hc1", "cluster"):
        raise ValueError("vcov must be classical, hc1 or cluster")
    if vcov == "cluster" and cluster is None:
        raise ValueError("Clustered errors need a cluster column")
    k = len(x)
    y = F.col(y) if isinstance(y, str) else y
    names = [f"x{i}" for i in range(k)]
    cols = [*(c.cast("double").alias(n) for n, c in zip(names, x.values(), strict=True)), y.cast("double").alias("y")]
    if cluster is not None:
        cols.append((F.col(cluster) if isinstance(cluster, str) else cluster).alias("g"))
    every = df.select(*cols)
    whole = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in every.columns))
    rows = every.filter(whole)

    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    total = lambda x: F.sum(F.when(whole, x))
    got = every.agg(
        F.count("*").alias("every"),
        F.count_if(whole).alias("n"),
        F.var_pop(F.when(whole, F.col("y"))).alias("spread"),
        *(total(F.col(names[i]) * F.col(names[j])).alias(f"a{i}_{j}") for i, j in pairs),
        *(total(F.col(c) * F.col("y")).alias(f"b{i}") for i, c in enumerate(names)),
    ).first()
    n = got["n"]
    if n <= k:
        raise ValueError(f"{n} rows cannot identify {k} terms")
    xx = np.empty((k, k))
    for i, j in pairs:
        xx[i, j] = xx[j, i] = got[f"a{i}_{j}"]
    bread = inv(xx, least_pivot)
    beta = bread @ np.array([got[f"b{i}"] for i in range(k)])

    residual = F.col("y") - _total([F.lit(float(b)) * F.col(c) for b, c in zip(beta, names, strict=True)])
    held = rows.withColumn("e", residual)
    squares = F.sum(F.col("e") * F.col("e")).alias("rss")
    outer = lambda s: [F.sum(s(i) * s(j)).alias(f"m{i}_{j}") for i, j in pairs]
    groups = None
    if vcov == "cluster":
        scores = held.groupBy("g").agg(*(F.sum(F.col(c) * F.col("e")).alias(f"s{i}") for i, c in enumerate(names)), squares)
        meat = scores.agg(F.count("*").alias("groups"), F.sum("rss").alias("rss"), *outer(lambda i: F.col(f"s{i}"))).first()
        groups = meat["groups"]
        if groups < 2:
            raise ValueError("Clustered errors need at least 2 clusters")
    elif vcov == "hc1":
        meat = held.agg(squares, *outer(lambda i: F.col(names[i]) * F.col("e"))).first()
    else:
        meat = held.agg(squares).first()
    rss, freedom = meat["rss"], n - k
    if vcov == "classical":
        cov = bread * (rss / (n - k))
    else:
        m = np.empty((k, k))
        for i, j in pairs:
            m[i, j] = m[j, i] = meat[f"m{i}_{j}"]
        scale = n / (n - k) if vcov == "hc1" else groups / (groups - 1) * (n - 1) / (n - k)
        cov = scale * bread @ m @ bread
        freedom = groups - 1 if vcov == "cluster" else n - k
    spread = got["spread"] * n
    return Fit(list(x), beta, np.sqrt(np.maximum(np.diag(cov), 0)), cov, n, freedom, rss, 1 - rss / spread if spread > 0 else math.nan, vcov, got["every"] - n, groups)


def ols(df: DataFrame, dependent: str, predictors: Sequence[str]) -> Fit:
    """With an intercept and classical errors."""
    return fit_ols(df, dependent, {"(Intercept)": F.lit(1.0), **{p: F.col(p) for p in predictors}}, vcov="classical", least_pivot=1e-10)


def ancova(df: DataFrame, dependent: str, covariates: Sequence[str], group: str) -> dict:
    """Partial F of the group's dummies (against its first level) beside the covariates."""
    used = df.filter(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in (dependent, *covariates, group))))
    levels = sorted(r[0] for r in used.select(group).distinct().collect())
    if len(levels) < 2:
        raise ValueError("ancova needs at least 2 groups")
    base = {"(Intercept)": F.lit(1.0), **{c: F.col(c) for c in covariates}}
    dummies = {f"{group}={v}": (F.col(group) == F.lit(v)).cast("double") for v in levels[1:]}
    reduced = fit_ols(used, dependent, base, vcov="classical", least_pivot=1e-10)
    full = fit_ols(used, dependent, base | dummies, vcov="classical", least_pivot=1e-10)
    d1, d2 = len(dummies), full.n - len(full.terms)
    f = ((reduced.rss - full.rss) / d1) / (full.rss / d2) if full.rss > 0 else math.inf
    return {"f": f, "df1": d1, "df2": d2, "p": 1 - f_cdf(f, d1, d2), "reduced": reduced, "full": full}


def within_transform(df: DataFrame, columns: Sequence[str], unit: str, time: str) -> DataFrame:
    """``df`` with the columns freed of unit and time effects, for balanced and unbalanced panels.

    Time effects are the solution of their normal equations after unit means are taken out; these
    are as many as there are periods and are solved on the driver. No iteration is needed.
    """
    per_unit = Window.partitionBy(unit)
    means = df.withColumns({f"d_{i}": F.col(c).cast("double") - F.avg(F.col(c).cast("double")).over(per_unit) for i, c in enumerate(columns)})
    sums = means.groupBy(time).agg(F.count("*").alias("n"), *(F.sum(f"d_{i}").alias(f"r{i}") for i in range(len(columns)))).collect()
    times = sorted(r[time] for r in sums)
    place = {t: i for i, t in enumerate(times)}
    a, right = np.zeros((len(times), len(times))), np.zeros((len(times), len(columns)))
    for r in sums:
        a[place[r[time]], place[r[time]]] = r["n"]
        right[place[r[time]]] = [r[f"r{i}"] for i in range(len(columns))]
    seen = df.groupBy(unit, time).agg(F.count("*").alias("c")).groupBy(unit).agg(F.collect_list(F.struct(F.col(time).alias("t"), "c")).alias("ts"), F.sum("c").alias("n"))
    cross = seen.select("n", "ts", F.explode("ts").alias("a")).select("n", "a", F.explode("ts").alias("b"))
    for r in cross.groupBy(F.col("a.t").alias("s"), F.col("b.t").alias("t")).agg(F.sum(F.col("a.c") * F.col("b.c") / F.col("n")).alias("w")).collect():
        a[place[r["s"]], place[r["t"]]] -= r["w"]
    effects = np.linalg.lstsq(a, right, rcond=None)[0]
    keys = F.array(*(F.lit(t) for t in times))
    at = lambda i: F.element_at(F.map_from_arrays(keys, F.array(*(F.lit(float(v)) for v in effects[:, i]))), F.col(time))
    free = {c: F.col(c).cast("double") - at(i) for i, c in enumerate(columns)}
    out = df.withColumns(free)
    return out.withColumns({c: F.col(c) - F.avg(c).over(per_unit) for c in columns})
