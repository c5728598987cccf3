"""Difference-in-differences estimators on panels, from Spark aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ols import Fit, fit_ols, within_transform
from .special import normal_cdf, probit


@dataclass
class Effect:
    """One estimate; ``model`` is the regression behind it, if there is one."""

    att: float
    se: float
    ci: tuple[float, float]
    p: float
    estimator: str
    model: Fit | None = None

    def summary(self) -> str:
        return f"{self.estimator}: {self.att:.4f} (SE {self.se:.4f}), 95% CI [{self.ci[0]:.4f}, {self.ci[1]:.4f}], p = {self.p:.4f}"


def _flag(c: str) -> Column:
    """Not zero is 1, null is 0; numbers and booleans only."""
    return F.when(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) != 0, 1.0).otherwise(0.0)


def _numeric_flags(df: DataFrame, *names: str) -> None:
    for n in names:
        if df.schema[n].dataType.simpleString() == "string":
            raise TypeError(f"{n} is a string; treatment and period flags are numbers or booleans")


def _effect(fit: Fit, term: str, estimator: str) -> Effect:
    i = fit.terms.index(term)
    return Effect(float(fit.beta[i]), float(fit.se[i]), fit.ci[i], float(fit.p[i]), estimator, fit)


def did(df: DataFrame, outcome: str, treatment: str, time: str, *, covariates: Sequence[str] = (), cluster: str | None = None, vcov: str | None = None) -> Effect:
    """y on treated, post, treated x post and covariates; the interaction is the effect."""
    _numeric_flags(df, treatment, time)
    t, p = _flag(treatment), _flag(time)
    terms = {"(Intercept)": F.lit(1.0), "treated": t, "post": p, "treated:post": t * p, **{c: F.col(c) for c in covariates}}
    return _effect(fit_ols(df, outcome, terms, vcov=vcov or ("cluster" if cluster else "hc1"), cluster=cluster), "treated:post", "DiD")


def _complete(df: DataFrame, names: Sequence[str]) -> DataFrame:
    for n in names:
        df = df.where(F.col(n).isNotNull())
    return df


def twfe(df: DataFrame, outcome: str, treatment: str, unit: str, time: str, *, covariates: Sequence[str] = (), cluster: str | None = None) -> Effect:
    """Unit and period effects taken out, then y on the treatment, errors clustered by unit."""
    rows = _complete(df, (outcome, unit, time, *covariates)).withColumns({"y_": F.col(outcome).cast("double"), "t_": _flag(treatment), "g_": F.col(cluster or unit)})
    extra = {f"c{i}_": c for i, c in enumerate(covariates)}
    rows = rows.withColumns({k: F.col(c).cast("double") for k, c in extra.items()}) if extra else rows
    free = within_transform(rows, ["y_", "t_", *extra], unit, time)
    fit = fit_ols(free, "y_", {treatment: F.col("t_"), **{c: F.col(k) for k, c in extra.items()}}, vcov="cluster", cluster="g_")
    return _effect(fit, treatment, "TWFE")


def _adopted(c: Column) -> Column:
    """Adoption period; null, 0 and NaN mean never."""
    x = c.cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (x != 0), x)


@dataclass
class EventStudy:
    effects: list[dict]
    att: float | None
    model: Fit
    estimator: str = "EventStudy"


def event_study(df: DataFrame, outcome: str, unit: str, time: str, group: str, *, reference: int = -1, cluster: str | None = None, window: tuple[int, int] | None = None) -> EventStudy:
    """Effects by time since adoption, the reference period pinned at 0; never-treated rows are controls."""
    e = F.col(time).cast("double") - _adopted(F.col(group))
    if window:
        # least and greatest pass over nulls, which must stay: they are the never-treated
        e = F.when(e.isNotNull(), F.greatest(F.lit(float(window[0])), F.least(F.lit(float(window[1])), e)))
    rows = _complete(df, (outcome, unit, time)).withColumns({"y_": F.col(outcome).cast("double"), "e_": e, "g_": F.col(cluster or unit)})
    counts = {int(r["e_"]): r["n"] for r in rows.where("e_ is not null").groupBy("e_").agg(F.count("*").alias("n")).collect()}
    levels = sorted(x for x in counts if x != reference)
    if not levels:
        raise ValueError("No event times besides the reference")
    dummies = {f"d{i}_": x for i, x in enumerate(levels)}
    rows = rows.withColumns({k: F.coalesce((F.col("e_") == float(x)).cast("double"), F.lit(0.0)) for k, x in dummies.items()})
    free = within_transform(rows, ["y_", *dummies], unit, time)
    fit = fit_ols(free, "y_", {f"e={x}": F.col(k) for k, x in dummies.items()}, vcov="cluster", cluster="g_")
    effects = [
        {"event_time": x, "estimate": float(fit.beta[i]), "se": float(fit.se[i]), "ci_low": fit.ci[i][0], "ci_high": fit.ci[i][1], "p": float(fit.p[i]), "n": counts[x], "reference": False}
        for i, x in enumerate(levels)
    ]
    effects.append({"event_time": reference, "estimate": 0.0, "se": 0.0, "ci_low": 0.0, "ci_high": 0.0, "p": 1.0, "n": counts.get(reference, 0), "reference": True})
    effects.sort(key=lambda d: d["event_time"])
    post = [d for d in effects if d["event_time"] >= 0 and not d["reference"]]
    weight = sum(d["n"] for d in post)
    return EventStudy(effects, sum(d["estimate"] * d["n"] for d in post) / weight if weight else None, fit)


@dataclass
class GroupTime:
    attgt: list[dict]
    overall: dict | None
    by_group: list[dict]
    by_event_time: list[dict]
    control: str
    estimator: str = "CallawaySantAnna"
    draws: int = field(default=0)


def _cells(times: list[float], groups: list[float]) -> list[tuple[float, float, float]]:
    """(group, time, base): the base is the last time before adoption, or the time before a pre-period."""
    before = {t: (times[i - 1] if i else None) for i, t in enumerate(times)}
    out = []
    for g in groups:
        last = max((t for t in times if t < g), default=None)
        for t in times:
            base = last if t >= g else before[t]
            if base is not None and t != last:
                out.append((g, t, base))
    return out


def _weighted(cells: list[dict], key: str | None) -> list[dict]:
    found: dict = {}
    for c in cells:
        found.setdefault(c[key] if key else 0, []).append(c)
    out = []
    for k, cs in sorted(found.items()):
        w = sum(c["n_treated"] for c in cs)
        att = sum(c["att"] * c["n_treated"] for c in cs) / w
        out.append({"key": k, "att": att, "se": math.sqrt(sum((c["n_treated"] / w * c["se"]) ** 2 for c in cs)), "n_cells": len(cs)})
    return out


def _dressed(r: dict) -> dict:
    z, se = probit(0.975), r["se"]
    return r | {"ci_low": r["att"] - z * se, "ci_high": r["att"] + z * se, "p": 2 * (1 - normal_cdf(abs(r["att"] / se))) if se > 0 else 1.0}


def callaway_santanna(df: DataFrame, outcome: str, unit: str, time: str, group: str, *, control: str = "never", bootstrap: int = 0, seed: int = 1, order_by: str | None = None) -> GroupTime:
    """Effects by adoption group and time as 2 x 2 comparisons of long differences, and their averages.

    Controls are never-treated units, with ``notyet`` also those that adopt after both periods. A cell
    needs 2 treated and 2 control units. Rows are put together by unit once; differences of all cells
    are made there and averaged without another shuffle of rows. ``bootstrap`` reweights units: each
    draw gives every unit a Poisson(1) weight that depends on the unit and the seed only. Of several
    rows of a unit and time the last in ``order_by`` counts (else the largest outcome).
    """
    if control not in ("never", "notyet"):
        raise ValueError("control must be never or notyet")
    rows = _complete(df, (outcome, unit, time)).select(F.col(unit).alias("u"), F.col(time).cast("double").alias("t"), F.col(outcome).cast("double").alias("y"), _adopted(F.col(group)).alias("g"), (F.col(order_by) if order_by else F.col(outcome)).alias("o"))
    once = rows.groupBy("u", "t").agg(F.max_by("y", "o").alias("y"), F.min("g").alias("g"))
    units = once.groupBy("u").agg(F.min("g").alias("g"), F.map_from_entries(F.collect_list(F.struct("t", "y"))).alias("at"))
    times = sorted(r["t"] for r in once.select("t").distinct().collect())
    groups = sorted(r["g"] for r in once.where("g is not null").select("g").distinct().collect())
    if not groups:
        raise ValueError(f"No treated cohorts in {group}")
    cells = _cells(times, groups)

    def arm(g: float, t: float) -> Column:
        is_control = F.col("g").isNull()
        if control == "notyet":
            is_control = is_control | (F.col("g") > max(t, g))
        return F.when(F.col("g") == g, 1).when(is_control, 0)

    deltas = [F.try_element_at("at", F.lit(t)) - F.try_element_at("at", F.lit(b)) for g, t, b in cells]
    wide = units.select("u", F.array(*deltas).alias("d"), F.array(*(arm(g, t) for g, t, _ in cells)).alias("arm"))
    long = wide.select(F.posexplode(F.arrays_zip("d", "arm")).alias("cell", "x")).select("cell", "x.d", "x.arm").where("d is not null and arm is not null")
    stats = {(r["cell"], r["arm"]): r for r in long.groupBy("cell", "arm").agg(F.count("*").alias("n"), F.avg("d").alias("m"), F.var_samp("d").alias("v")).collect()}
    attgt = []
    for i, (g, t, _) in enumerate(cells):
        a, b = stats.get((i, 1)), stats.get((i, 0))
        if a and b and a["n"] >= 2 and b["n"] >= 2:
            attgt.append({"cell": i, "group": g, "time": t, "event_time": t - g, "att": a["m"] - b["m"], "se": math.sqrt(a["v"] / a["n"] + b["v"] / b["n"]), "n_treated": a["n"], "n_control": b["n"]})
    if not attgt:
        raise ValueError("No group and time can be estimated: treated and control units do not overlap")
    post = [c for c in attgt if c["event_time"] >= 0]
    overall = (_weighted(post, None) or [None])[0]
    by_group, by_event = _weighted(post, "group"), _weighted(attgt, "event_time")
    if bootstrap:
        _bootstrap(wide, attgt, len(cells), bootstrap, seed, overall, by_group, by_event)
    name = lambda rows, key: [_dressed(r | {key: r["key"]}) for r in rows]
    return GroupTime(attgt, _dressed(overall) if overall else None, name(by_group, "group"), name(by_event, "event_time"), control, draws=bootstrap)


def _bootstrap(wide: DataFrame, attgt: list[dict], n_cells: int, draws: int, seed: int, overall: dict | None, by_group: list[dict], by_event: list[dict]) -> None:
    """Replaces standard errors by the deviation of ``draws`` reweighted estimates."""

    def run(frames):
        for pdf in frames:
            if not len(pdf):
                continue
            d = np.array([[np.nan if v is None else v for v in row] for row in pdf["d"]], dtype=float)
            arm = np.array([[-1 if v is None or v != v else v for v in row] for row in pdf["arm"]], dtype=float)
            w = np.stack([np.random.default_rng([seed, int(h) & 0x7FFFFFFFFFFFFFFF]).poisson(1.0, draws) for h in pdf["h"]]).astype(float)
            for a in (0, 1):
                use = (arm == a) & ~np.isnan(d)
                sums, weights = w.T @ np.where(use, d, 0), w.T @ use.astype(float)
                b, c = np.indices(sums.shape)
                yield pd.DataFrame({"draw": b.ravel(), "cell": c.ravel(), "arm": a, "s": sums.ravel(), "w": weights.ravel()})

    sums = wide.select(F.xxhash64("u").alias("h"), "d", "arm").mapInPandas(run, "draw long, cell long, arm int, s double, w double")
    got = sums.groupBy("draw", "cell", "arm").agg(F.sum("s").alias("s"), F.sum("w").alias("w")).toPandas()
    s, w = np.zeros((2, draws, n_cells)), np.zeros((2, draws, n_cells))
    s[got["arm"], got["draw"], got["cell"]], w[got["arm"], got["draw"], got["cell"]] = got["s"], got["w"]
    with np.errstate(invalid="ignore", divide="ignore"):
        att = np.where((w[0] >= 2) & (w[1] >= 2), s[1] / w[1] - s[0] / w[0], np.nan)

    def deviation(cells: list[dict]) -> float | None:
        use = [c["cell"] for c in cells]
        weight = np.where(np.isnan(att[:, use]), 0, w[1][:, use])
        total = weight.sum(axis=1)
        est = np.nansum(np.where(weight > 0, att[:, use], 0) * weight, axis=1)[total > 0] / total[total > 0]
        return float(est.std(ddof=1)) if len(est) > 1 else None

    post = [c for c in attgt if c["event_time"] >= 0]
    if overall:
        overall["se"] = deviation(post) or overall["se"]
    for r in by_group:
        r["se"] = deviation([c for c in post if c["group"] == r["key"]]) or r["se"]
    for r in by_event:
        r["se"] = deviation([c for c in attgt if c["event_time"] == r["key"]]) or r["se"]


def check_parallel_trends(df: DataFrame, outcome: str, treatment: str, time: str, treatment_start: float, *, cluster: str | None = None) -> dict:
    """Whether trends differ before treatment: y on time, treated and their product, over earlier rows."""
    _numeric_flags(df, treatment)
    pre = _complete(df.where(F.col(time) < treatment_start), (outcome,))
    if pre.limit(8).count() < 8:
        raise ValueError("Fewer than 8 rows before treatment")
    t, d = F.col(time).cast("double"), _flag(treatment)
    fit = fit_ols(pre, outcome, {"(Intercept)": F.lit(1.0), "time": t, "treated": d, "time:treated": t * d}, vcov="cluster" if cluster else "hc1", cluster=cluster)
    e = _effect(fit, "time:treated", "ParallelTrends")
    return {"slope_difference": e.att, "se": e.se, "p": e.p, "passed": e.p > 0.05, "model": fit}


def placebo_test(df: DataFrame, outcome: str, treatment: str, time: str, treatment_start: float, *, placebo_start: float | None = None, cluster: str | None = None, covariates: Sequence[str] = ()) -> Effect:
    """The 2 x 2 estimate for a made-up start within the earlier periods, their middle by default."""
    pre = df.where(F.col(time) < treatment_start)
    if placebo_start is None:
        periods = sorted(r[0] for r in pre.select(time).distinct().collect())
        if len(periods) < 2:
            raise ValueError("A placebo test needs 2 periods before treatment")
        placebo_start = periods[len(periods) // 2]
    fake = pre.withColumn("placebo_post_", (F.col(time) >= placebo_start).cast("int"))
    return did(fake, outcome, treatment, "placebo_post_", covariates=covariates, cluster=cluster)
