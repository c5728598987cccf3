"""Claims panels: the typed file, its rollups, and a simulator with a planted effect."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .csv import from_text, read_csv, to_text

# Columns of a claims panel and their types.
COLUMNS = {
    "person_id": "string",
    "month": "string",
    "period": "int",
    "cohort": "int",
    "treated_now": "int",
    "medical_claims": "int",
    "pharmacy_fills": "int",
    "pharmacy_paid": "double",
    "enrolled_flag": "int",
}


def read_claims(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, dtypes=COLUMNS)


def claims_from_text(spark: SparkSession, text: str) -> DataFrame:
    return from_text(spark, text, dtypes=COLUMNS)


def enrolled_member_months(df: DataFrame) -> DataFrame:
    return df.where(F.col("enrolled_flag") == 1)


def _sum(c: str, name: str):
    return F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0)).alias(name)


def member_rollup(df: DataFrame) -> DataFrame:
    return df.groupBy("person_id").agg(*(_sum(c, f"{c}_total") for c in ("medical_claims", "pharmacy_fills", "pharmacy_paid")), F.count("month").alias("member_months"))


def monthly_trend(df: DataFrame) -> DataFrame:
    return df.groupBy("month").agg(*(_sum(c, c) for c in ("medical_claims", "pharmacy_fills", "pharmacy_paid")), F.count("person_id").alias("member_months")).orderBy("month")


@dataclass(frozen=True)
class PanelOptions:
    """Sizes and rates of a simulated panel; treatment averts (1 - rate_ratio) of claims after a ramp."""

    members: int = 1500
    months: int = 24
    start_month: str = "2024-01"
    seed: int = 42
    baseline_intensity: float = 6.0
    intensity_shape: float = 1.0
    burst_shape: float = 2.0
    zero_inflation: float = 0.25
    seasonal_amplitude: float = 0.15
    fill_intensity: float = 0.15
    paid_log_mean: float = 4.0
    paid_log_sd: float = 1.5
    full_enrollment_share: float = 0.75
    cohort_periods: tuple[int, ...] = (8, 12, 16)
    cohort_share: float = 0.2
    rate_ratio: float = 0.6
    ramp_months: int = 3


def _labels(o: PanelOptions) -> list[str]:
    year, month = map(int, o.start_month.split("-"))
    return [f"{year + (month - 1 + i) // 12}-{(month - 1 + i) % 12 + 1:02d}" for i in range(o.months)]


def _enrolled(g: np.random.Generator, o: PanelOptions) -> np.ndarray:
    """Full coverage, or a late start, an early end, or a two-month gap."""
    out = np.ones(o.months, bool)
    if g.random() < o.full_enrollment_share:
        return out
    quarter = max(1, o.months // 4)
    kind, step = g.integers(3), int(g.integers(quarter))
    if kind == 0:
        out[: 1 + step] = False
    elif kind == 1:
        out[o.months - 1 - step :] = False
    else:
        at = quarter + int(g.integers(2 * quarter))
        out[at : at + 2] = False
    return out


def _member(i: int, cohort: int, o: PanelOptions) -> pd.DataFrame:
    """All months of one member from a generator of its own, so any task can make any member."""
    g = np.random.default_rng([o.seed, i])
    t = np.arange(o.months)
    enrolled = _enrolled(g, o)
    intensity = g.gamma(o.intensity_shape, o.baseline_intensity / o.intensity_shape)
    season = 1 + o.seasonal_amplitude * np.cos(2 * math.pi * (np.array([int(m[5:]) for m in _labels(o)]) - 1) / 12)
    active = enrolled & (g.random(o.months) >= o.zero_inflation)
    untreated = np.where(active, g.poisson(intensity * season * g.gamma(o.burst_shape, 1 / o.burst_shape, o.months)), 0)
    event = t - cohort
    treated = (cohort > 0) & (event >= 0)
    averted = np.where(treated, (1 - o.rate_ratio) * np.minimum(1, (event + 1) / o.ramp_months), 0.0)
    claims = untreated - g.binomial(untreated, averted)
    fills = np.where(active, g.poisson(o.fill_intensity * intensity / o.baseline_intensity, o.months), 0)
    paid = [round(float(g.lognormal(o.paid_log_mean, o.paid_log_sd, n).sum()), 2) for n in fills]
    return pd.DataFrame({"person_id": f"sim-{i + 1:06d}", "month": _labels(o), "period": t, "cohort": cohort, "treated_now": treated.astype(int), "medical_claims": claims, "pharmacy_fills": fills, "pharmacy_paid": paid, "enrolled_flag": enrolled.astype(int), "untreated_claims": untreated})


def simulate_claims_panel(spark: SparkSession, options: PanelOptions | None = None, *, with_untreated: bool = False) -> DataFrame:
    """A member-month panel made on the executors, the same for a seed however it is partitioned.

    Cohorts are exact shares of the members, dealt by a hash order. ``with_untreated`` adds the claims
    that each month would have had without treatment.
    """
    o = options or PanelOptions()
    share = round(o.members * o.cohort_share)
    from ..operators.relational import numbered

    ids = spark.range(o.members).select(F.col("id"), F.xxhash64("id", F.lit(o.seed)).alias("h"))
    place = numbered(ids, ["h", "id"], "place")
    cohort = F.lit(0)
    for k, period in enumerate(o.cohort_periods):
        cohort = F.when((F.col("place") >= k * share) & (F.col("place") < (k + 1) * share), period).otherwise(cohort)

    def run(frames):
        for pdf in frames:
            for i, c in zip(pdf["id"], pdf["cohort"], strict=True):
                yield _member(int(i), int(c), o)

    schema = ", ".join([*(f"{n} {t}" for n, t in COLUMNS.items()), "untreated_claims int"])
    out = place.select("id", cohort.alias("cohort")).mapInPandas(run, schema)
    return out if with_untreated else out.drop("untreated_claims")


def planted_truth(panel: DataFrame, options: PanelOptions | None = None) -> dict:
    """The effect that a panel made ``with_untreated`` really has: in all, phased in, by event time and cohort."""
    o = options or PanelOptions()
    rows = panel.where("treated_now = 1 and enrolled_flag = 1").withColumns({"event_time": F.col("period") - F.col("cohort"), "delta": (F.col("medical_claims") - F.col("untreated_claims")).cast("double")})
    total = rows.agg(F.avg("delta").alias("att"), F.avg(F.when(F.col("event_time") >= o.ramp_months - 1, F.col("delta"))).alias("phased"), F.count("*").alias("n")).first()
    by = lambda key: [{key: r[key], "att": r["att"], "n": r["n"]} for r in rows.groupBy(key).agg(F.avg("delta").alias("att"), F.count("*").alias("n")).orderBy(key).collect()]
    return {"att": total["att"], "att_fully_phased_in": total["phased"], "treated_member_months": total["n"], "att_by_event_time": by("event_time"), "att_by_cohort": by("cohort"), "rate_ratio": o.rate_ratio, "ramp_months": o.ramp_months}


def claims_panel_csv(spark: SparkSession, options: PanelOptions | None = None) -> dict:
    """A small panel as CSV text, with its truth and options."""
    o = options or PanelOptions()
    panel = simulate_claims_panel(spark, o, with_untreated=True).cache()
    text = to_text(panel.drop("untreated_claims").orderBy("person_id", "period")) + "\n"
    truth = planted_truth(panel, o)
    panel.unpersist()
    return {"csv": text, "truth": truth, "options": asdict(o)}
