"""Estimators against exact values, numpy and simulated truth."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from granary.sources import claims
from granary.stats import density, did, distributions, experiment, matrix, ols, power, special, table_one, ttests


def test_special_functions():
    assert special.probit(0.975) == pytest.approx(1.959963985, abs=1e-8) and special.probit(0) == -math.inf
    assert special.normal_cdf(1.96) == pytest.approx(0.9750021, abs=1e-6)
    # fixed values: percentage points of the standard tables
    for t, df, p in ((2.228, 10, 0.05), (2.0, 5, 0.10194), (12.706, 1, 0.05)):
        assert special.t_two_sided_p(t, df) == pytest.approx(p, abs=2e-5)
    assert special.chi2_cdf(3.841, 1) == pytest.approx(0.95, abs=1e-4) and special.chi2_cdf(18.307, 10) == pytest.approx(0.95, abs=1e-4)
    assert special.f_cdf(4.965, 1, 10) == pytest.approx(0.95, abs=1e-4) and special.f_cdf(3.326, 5, 10) == pytest.approx(0.95, abs=1e-3)
    assert special.incomplete_gamma(3, 2) == pytest.approx(1 - math.exp(-2) * (1 + 2 + 2), abs=1e-12)
    assert special.student_t_cdf(0, 3) == 0.5 and special.log_gamma(5) == pytest.approx(math.log(24))


def test_matrices():
    a = [[2.0, 1.0], [1.0, 3.0]]
    assert np.allclose(matrix.matmul(a, matrix.inv(a)), matrix.identity(2)) and matrix.dot([1, 2], [3, 4]) == 11
    assert matrix.matvec(a, [1, 1]).tolist() == [3, 4] and matrix.transpose([[1, 2]]).shape == (2, 1)
    with pytest.raises(ValueError, match="singular"):
        matrix.inv([[1, 2], [2, 4]])


def test_t_tests(spark):
    one = spark.createDataFrame([(v,) for v in (12, 14, 11, 13, 15, 12, 13, None)], "v int")
    r = ttests.one_sample(one, "v", 12)
    x = np.array([12, 14, 11, 13, 15, 12, 13])
    assert r.t == pytest.approx((x.mean() - 12) / (x.std(ddof=1) / math.sqrt(7))) and r.df == 6 and 0 < r.p < 1
    two = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 4.0), ("b", 6.0), ("b", 9.0), ("b", None)], "g string, v double")
    assert ttests.two_sample(two, "v", "g", "a", "b").df == 4
    w = ttests.welch(two, "v", "g", "a", "b")
    va, vb = np.var([1, 2, 3], ddof=1) / 3, np.var([4, 6, 9], ddof=1) / 3
    assert w.t == pytest.approx((2 - 19 / 3) / math.sqrt(va + vb)) and w.df == pytest.approx((va + vb) ** 2 / (va**2 / 2 + vb**2 / 2))
    with pytest.raises(ValueError):
        ttests.welch(two, "v", "g", "a", "zz")
    with pytest.raises(TypeError):
        ttests.one_sample(two, "g", 1)


def by_hand(x, y, vcov, g=None):
    n, k = x.shape
    bread = np.linalg.inv(x.T @ x)
    b = bread @ x.T @ y
    e = y - x @ b
    if vcov == "classical":
        return b, np.sqrt(np.diag(bread) * (e @ e) / (n - k))
    if vcov == "hc1":
        meat, scale = (x * e[:, None] ** 2).T @ x, n / (n - k)
    else:
        s = pd.DataFrame(x * e[:, None]).groupby(g).sum().to_numpy()
        meat, scale = s.T @ s, len(s) / (len(s) - 1) * (n - 1) / (n - k)
    return b, np.sqrt(np.diag(scale * bread @ meat @ bread))


def test_ols_equals_numpy(spark):
    rng = np.random.default_rng(0)
    n = 300
    pdf = pd.DataFrame({"a": rng.normal(size=n), "b": rng.normal(size=n), "g": rng.integers(0, 12, n)})
    pdf["y"] = 1 + 2 * pdf.a - pdf.b + rng.normal(size=n) * (1 + abs(pdf.a))
    df = spark.createDataFrame(pdf).unionByName(spark.createDataFrame([(None, 1.0, 1, 2.0)], "a double, b double, g long, y double"))
    x = np.column_stack([np.ones(n), pdf.a, pdf.b])
    for vcov in ("classical", "hc1", "cluster"):
        f = ols.fit_ols(df, "y", {"c": F.lit(1.0), "a": F.col("a"), "b": F.col("b")}, vcov=vcov, cluster="g" if vcov == "cluster" else None)
        beta, se = by_hand(x, pdf.y.to_numpy(), vcov, pdf.g)
        assert np.allclose(f.beta, beta) and np.allclose(f.se, se) and f.n == n and f.n_dropped == 1
    assert f.df == 11 and f.ci[0][1] - f.beta[0] == pytest.approx(1.96 * f.se[0]) and f.to_dataframe(spark).count() == 3
    exact = ols.ols(spark.createDataFrame([(i, 2 + 3 * i) for i in range(5)], "x int, y int"), "y", ["x"])
    assert exact.beta == pytest.approx([2, 3]) and exact.r2 == pytest.approx(1)
    with pytest.raises(ValueError, match="singular"):
        ols.ols(df.withColumn("a2", F.col("a") * 2), "y", ["a", "a2"])
    with pytest.raises(ValueError, match="rows"):
        ols.ols(df.limit(2), "y", ["a", "b"])
    r = ols.ancova(df.withColumn("arm", F.col("g") % 3), "y", ["a"], "arm")
    assert r["df1"] == 2 and 0 <= r["p"] <= 1 and r["full"].rss <= r["reduced"].rss


@pytest.fixture(scope="module")
def panel(spark):
    """60 units over 8 periods; a third adopts in period 3, a third in 5, the effect is 2."""
    rng = np.random.default_rng(4)
    rows = []
    for u in range(60):
        g = (None, 3, 5)[u % 3]
        level = rng.normal()
        for t in range(8):
            d = int(g is not None and t >= g)
            rows.append((f"u{u}", t, g, int(g is not None), int(t >= 3), d, float(level + 0.3 * t + 2 * d + 0.1 * rng.normal())))
    return spark.createDataFrame(rows, "unit string, period int, grp int, treated int, post int, d int, y double")


def test_textbook_did(spark):
    rows = [(1, 0, 0, 9.0), (2, 0, 0, 10.0), (3, 0, 1, 12.0), (4, 0, 1, 13.0), (5, 1, 0, 10.0), (6, 1, 0, 11.0), (7, 1, 1, 16.0), (8, 1, 1, 17.0)]
    df = spark.createDataFrame(rows, "i int, treated int, post int, outcome double")
    r = did.did(df, "outcome", "treated", "post", vcov="classical")
    assert r.att == pytest.approx(3) and "DiD" in r.summary()
    with pytest.raises(TypeError):
        did.did(df.withColumn("treated", F.col("treated").cast("string")), "outcome", "treated", "post")


def demeaned(pdf, v):
    """Two-way within transform by dummy regression."""
    x = pd.concat([pd.get_dummies(pdf.unit), pd.get_dummies(pdf.period)], axis=1).to_numpy(float)
    return pdf[v] - x @ np.linalg.lstsq(x, pdf[v].to_numpy(float), rcond=None)[0]


@pytest.mark.parametrize("balanced", [True, False])
def test_within_and_twfe(spark, panel, balanced):
    df = panel if balanced else panel.where("crc32(concat(unit, period)) % 10 <> 0")
    free = ols.within_transform(df.withColumn("y0", F.col("y")), ["y", "d"], "unit", "period").toPandas().rename(columns={"y": "yf", "d": "df", "y0": "y"})
    pdf = free.assign(d=[int(g == g and t >= g) for g, t in zip(free.grp, free.period, strict=True)])
    assert np.allclose(free.yf, demeaned(pdf, "y"), atol=1e-8) and np.allclose(free["df"], demeaned(pdf, "d"), atol=1e-8)
    r = did.twfe(df, "y", "d", "unit", "period")
    assert abs(r.att - 2) < 0.05 and r.model.n_clusters == 60


def test_event_study_and_group_time(panel):
    r = did.event_study(panel, "y", "unit", "period", "grp")
    assert abs(r.att - 2) < 0.1 and [e["event_time"] for e in r.effects] == list(range(-5, 5))
    assert all(abs(e["estimate"]) < 0.15 for e in r.effects if e["event_time"] < 0)
    for control in ("never", "notyet"):
        c = did.callaway_santanna(panel, "y", "unit", "period", "grp", control=control)
        assert c.overall["ci_low"] < 2 < c.overall["ci_high"] + 0.05 and len(c.by_group) == 2
        assert all(abs(x["att"] - (2 if x["event_time"] >= 0 else 0)) < 0.25 for x in c.attgt)
    b = did.callaway_santanna(panel, "y", "unit", "period", "grp", bootstrap=60)
    assert b.overall["att"] == did.callaway_santanna(panel, "y", "unit", "period", "grp").overall["att"] and 0.005 < b.overall["se"] < 0.2
    with pytest.raises(ValueError):
        did.callaway_santanna(panel.where("grp is null"), "y", "unit", "period", "grp")


def test_trends_and_placebo(panel):
    early = panel.where("grp is null or grp = 5")
    t = did.check_parallel_trends(early, "y", "treated", "period", 5)
    assert t["passed"] and abs(t["slope_difference"]) < 0.2
    assert abs(did.placebo_test(early, "y", "treated", "period", 5, cluster="unit").att) < 0.2
    with pytest.raises(ValueError):
        did.check_parallel_trends(early.limit(4), "y", "treated", "period", 5)


def test_table_one(spark):
    rows = [("a" if i % 2 else "b", float(i), "x" if i % 3 else None) for i in range(40)]
    t = {r.characteristic: r for r in table_one.table_one(spark.createDataFrame(rows, "arm string, v double, s string"), "arm", ["v"], ["s"], labels={"v": "Value"}).collect()}
    assert t["n"].a == "20" and t["Value, mean (SD)"].a.startswith("20.0 (") and t["Value, mean (SD)"].p == "0.791" and t["   x"].a.endswith("%)")
    assert table_one.chi_square_p([[10, 20], [20, 10]]) == pytest.approx(0.00982, abs=1e-4) and table_one.format_p(0.0001) == "<0.001"
    with pytest.raises(ValueError):
        table_one.table_one(spark.createDataFrame([("a", 1.0)], "arm string, v double"), "arm", ["v"])


def test_density(spark):
    df = spark.createDataFrame([("g", float(v)) for v in np.random.default_rng(1).normal(size=400)] + [("h", 1.0)], "k string, v double")
    k = density.kde(df, "v", by=["k"], n=300).toPandas().sort_values("x")
    assert set(k.k) == {"g"} and np.trapezoid(k.density, k.x) == pytest.approx(1, abs=0.01)
    assert density.kde(df, "v", n=50, normalize=True).agg(F.max("density").alias("m")).first().m == pytest.approx(1)


def test_power():
    assert power.sample_size_two_proportions(0.5, 0.6) == 388 and math.isinf(power.sample_size_two_proportions(0.1, 0.1))
    assert power.sample_size_two_means(0, 1, 2) == 63 and power.standardized_mean_difference(1, 2, 2) == 0.5
    one, two, d = (power.power_analysis(0.1, 0.02, design=x) for x in ("one-sided-proportions", "two-sided-proportions", "difference-in-differences"))
    assert two.n_per_arm > one.n_per_arm and d.n_per_arm == math.ceil(1.5 * power._two_rates(0.1, 0.12, one.z_alpha, one.z_beta)) and power.power_analysis(0.1, 0.02, design="single-arm").arms == 1
    c = power.evaluate_cadence([{"cost": 2, "behavior_change": 0.1}], [[True, False, True]], 0.2, 5000)
    assert c["lift"] == pytest.approx(0.19) and c["touches"] == 2 and c["meets_power"]
    assert power.variance_cluster(1, 10, 20, 0.05) == pytest.approx(1 / 200 * 1.95) and len(power.variance_comparison("m", [1, 2], sigma=1, k=2, m=3, rho=0.1, n=6)) == 6
    assert power.design_matrix("Stepped-wedge", 4).tolist() == [[0, 1, 1, 1], [0, 0, 1, 1], [0, 0, 0, 1]] and len(power.design_matrix_rows("Cross-over")) == 4
    v = power.treatment_variance(m=20, design="Stepped-wedge", periods=4, icc=0.05, cac=0.9)
    assert 0 < power.treatment_variance(m=40, design="Stepped-wedge", periods=4, icc=0.05, cac=0.9) < v
    assert power.treatment_variance(m=10, design="Parallel", periods=1, icc=0.0) == pytest.approx(2 / 10)


def test_distributions(spark):
    for kind in distributions.SAMPLERS:
        d = distributions.DistP(kind, seed=1, size=500, bounds=(-1e9, 1e9))
        assert d.size == 500 and math.isfinite(d.stats["mean"])
    d = distributions.DistP("normal", {"mean": 5, "std": 2}, seed=3)
    again = distributions.DistP("normal", {"mean": 5, "std": 2}, seed=3)
    assert (d.samples == again.samples).all() and abs(d.stats["mean"] - 5) < 0.3 and d.samples.min() >= 0
    e = d.copy().mult_const(2).chain_sub(d)
    assert np.allclose(e.samples, d.samples) and np.allclose(d.copy().chain_divide(d).samples, 1)
    lo, hi = d.conf_int()
    assert lo < d.stats["median"] < hi and d.to_record()["p05"] < d.to_record()["p95"] and d.to_dataframe(spark).count() == d.size
    s = distributions.DistP("normal", bounds=(0, 1), bound_method="stack", seed=1)
    assert s.samples.min() == 0 and s.samples.max() == 1 and s.complement(seed=2).name.endswith("(complement)")
    with pytest.raises(ValueError):
        d.chain_add(distributions.DistP(samples=[1.0]))
    with pytest.raises(ValueError):
        distributions.DistP("uniform", bounds=(5, 6))
    with pytest.raises(ValueError):
        distributions.DistP()
    for kind in ("normal", "exponential", "weibull", "gamma"):
        r = distributions.draws(spark, kind, 4000, 5).agg(F.count("value").alias("n"), F.avg("value").alias("m")).first()
        assert r.n == 4000 and abs(r.m - (0 if kind == "normal" else 1)) < 0.1


def test_experiment(spark):
    rng = np.random.default_rng(2)
    rows = []
    for u in range(200):
        score = float(rng.random())
        rows += [(u, t, score, int(rng.random() < 0.1 + 0.5 * score)) for t in range(12)]
    panel = spark.createDataFrame(rows, "person int, period int, score double, event int")
    d = experiment.ExperimentDesign.from_panel(panel, "person", "event", period="period", risk_score="score", pre_periods=range(6))
    assert 0 < d.estimated_correlation < 1
    e = d.stratify({"low": (0, 0.5), "high": (0.5, 1)}).arms([{"name": "call", "channels": [{"reach": 0.5, "efficacy": 0.4, "cost": 3}]}, {"name": "mail", "relative_effect": -0.1, "cost_per_member": 1}]).power(method="cuped").build()
    assert [s.available for s in e.strata] == [100, 100] and e.strata[0].base_rate < e.strata[1].base_rate
    assert e.n_arms == 3 and e.adjustment == 1.5 and e.arms[0].relative_effect == pytest.approx(-0.2)
    assert len(e.feasibility()) == 2 and e.to_dataframe(spark).count() == 4 and "cuped" in e.describe()
    b = e.business_case(1000)
    assert b["totals"]["value"] == sum(r["value"] for r in b["by_cell"])
    shares = e.simulate_power(spark, 300, block=100).collect()
    assert all(0.6 < r.share <= 1 and r.trials == 300 for r in shares) and len(shares) == len(e.cells)
    assert sorted(map(tuple, shares)) == sorted(map(tuple, e.simulate_power(spark, 300, block=100).collect()))
    flow = {(r.stage, r.arm): r.units for r in e.flow(spark).collect()}
    assert flow["screened", None] == 200 and flow["allocated", None] == sum(e.required_in_stratum(s.name) for s in e.strata)
    assert sum(n for (stage, _), n in flow.items() if stage == "planned") == pytest.approx(flow["allocated", None])
    plan = e.schedule(spark, (("a", 2), ("b", 3))).collect()
    assert [(r.phase, r.first_month, r.after_month) for r in plan] == [("a", 0, 2)] * 2 + [("b", 2, 5)] * 2
    assert len(e.to_design_tree()["cohorts"]) == 2
    assert [experiment.multi_arm_adjustment(k) for k in (2, 3, 4, 5, 8)] == [1, 1.5, 4 / 3, 1.25, 2]
    assert math.isinf(experiment.sample_size_per_arm(0.1, 0.1)["n_per_arm"]) and experiment.sample_size_per_arm(0.1, 0.12, experiment.Settings(effect_size="pooled"))["n_per_arm"] == power.sample_size_two_proportions(0.1, 0.12)
    with pytest.raises(ValueError):
        experiment.ExperimentDesign.from_assumptions().build()


def test_claims(spark):
    o = claims.PanelOptions(members=300)
    panel = claims.simulate_claims_panel(spark, o, with_untreated=True).cache()
    assert panel.count() == 300 * 24 and dict(panel.dtypes) == claims.COLUMNS | {"untreated_claims": "int"}
    assert panel.select("person_id", "cohort").distinct().where("cohort > 0").count() == 180
    truth = claims.planted_truth(panel, o)
    assert -3 < truth["att_fully_phased_in"] <= truth["att"] < 0 and len(truth["att_by_cohort"]) == 3
    same = claims.simulate_claims_panel(spark, o, with_untreated=True).repartition(3)
    assert same.exceptAll(panel).count() == 0
    rows = claims.enrolled_member_months(panel)
    assert claims.member_rollup(rows).agg(F.sum("member_months")).first()[0] == rows.count() and claims.monthly_trend(rows).count() == 24
    r = did.callaway_santanna(rows, "medical_claims", "person_id", "period", "cohort")
    assert abs(r.overall["att"] - truth["att"]) < 1.5
    text = claims.claims_panel_csv(spark, claims.PanelOptions(members=5, months=3))["csv"]
    assert text.startswith("person_id,month,") and claims.claims_from_text(spark, text).count() == 15


def test_stream_windows(spark, tmp_path):
    from granary.streaming.windows import group_by_dynamic_stream, to_memory

    src = str(tmp_path / "in")
    spark.range(0, 7200, 60).select(F.timestamp_seconds(F.col("id")).alias("ts"), F.lit(1).alias("v")).write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, v int").parquet(src)
    q = to_memory(group_by_dynamic_stream(stream, "ts", "30m", F.sum("v").alias("n"), period="1h", late="0 seconds"), "out", "complete")
    q.processAllAvailable()
    q.stop()
    assert {r.n for r in spark.table("out").collect()} == {30, 60}
    with pytest.raises(ValueError):
        group_by_dynamic_stream(stream, "ts", "1mo", F.sum("v"))
