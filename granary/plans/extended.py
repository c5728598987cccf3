"""Further registered queries: sources, unkeyed windows, estimators, design figures and chart data, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import aggs as A
from ..functions import exprs as E
from ..functions import format as M
from ..operators import ordered
from ..operators import profile as P
from ..operators import relational as R
from ..session import table
from ..sources import claims, csv, frames
from ..sources.random import Mulberry
from ..stats import density, did, experiment, matrix, ols, power, special, table_one
from .catalogue import query

# -- sources: small tables go out as Python data or text and come back as frames


@query("SELECT n_nationkey::INTEGER AS n_nationkey, n_name, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_regionkey END::INTEGER AS r FROM nation")
def frame_from_rows(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", "n_name", F.when(F.col("n_nationkey") % 4 != 0, F.col("n_regionkey")).alias("r"))
    return frames.from_rows(spark, frames.to_rows(n))


@query("SELECT s_suppkey::INTEGER AS s_suppkey, s_name, s_acctbal FROM supplier")
def frame_from_columns(spark, sf):
    return frames.from_columns(spark, frames.to_columns(table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal")))


@query("SELECT s_acctbal AS value FROM supplier")
def column_from_values(spark, sf):
    return frames.column(spark, frames.values(table(spark, sf, "supplier"), "s_acctbal", order_by=["s_suppkey"]), "f64")


@query("SELECT count(*) AS n_rows, 3::BIGINT AS n_columns FROM region, (SELECT 1) WHERE true")
def frame_shape(spark, sf):
    rows, columns = frames.shape(R.with_columns(table(spark, sf, "region"), k=E.add(F.col("r_regionkey"), 1)))
    return spark.createDataFrame([(rows, columns)], "n_rows long, n_columns long")


@query("SELECT s_suppkey::DOUBLE AS s_suppkey, s_name || ', \"x\"' AS s_name, s_acctbal, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey % 2 = 0 END AS even FROM supplier")
def csv_round_trip(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", F.concat("s_name", F.lit(', "x"')).alias("s_name"), "s_acctbal", F.when(F.col("s_suppkey") % 3 != 0, F.col("s_suppkey") % 2 == 0).alias("even"))
    return csv.from_text(spark, csv.to_text(s))


@query("SELECT o_orderkey, o_totalprice FROM (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i IN (0, 5, 17, 400)")
def column_take(spark, sf):
    return frames.take(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [17, 0, 400, 5], order_by=["o_orderkey"])


@query("SELECT 'v' AS column, count(*) FILTER (event_id % 9 = 0) AS nulls FROM events UNION ALL SELECT 'event_type', count(*) - count(event_type) FROM events")
def column_null_count(spark, sf):
    return frames.null_counts(table(spark, sf, "events").select(F.when(F.col("event_id") % 9 != 0, F.col("value")).alias("v"), "event_type"))


_M32 = "4294967296"


@query(f"""
WITH s AS (SELECT i, (42 + i * 1831565813::HUGEINT) % {_M32} AS a FROM range(1, 201) r(i)),
m AS (SELECT i, ((xor(a::BIGINT, a::BIGINT >> 15)::HUGEINT * (a::BIGINT | 1)) % {_M32})::BIGINT AS x FROM s),
w AS (SELECT i, xor(x, ((x + (xor(x, x >> 7)::HUGEINT * (x | 61)) % {_M32}) % {_M32})::BIGINT) AS x FROM m)
SELECT i, xor(x, x >> 14) / {_M32}::DOUBLE AS u FROM w
""")
def random_sequence(spark, sf):
    draw = Mulberry(42)
    return spark.createDataFrame([(i, draw()) for i in range(1, 201)], "i long, u double")


# -- claims panels from the events table

_CLAIMS = """(SELECT user_id::VARCHAR AS person_id, strftime(ts, '%Y-%m') AS month, count(*) FILTER (event_type = 'click') AS medical_claims, count(*) FILTER (event_type = 'view') AS pharmacy_fills,
sum(value) FILTER (event_type = 'purchase') AS pharmacy_paid, CASE WHEN user_id % 5 = 0 THEN 0 ELSE 1 END AS enrolled_flag FROM events GROUP BY ALL)"""


def _claims(spark, sf):
    e = table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("person_id"), F.date_format("ts", "yyyy-MM").alias("month"), F.when(F.col("user_id") % 5 != 0, 1).otherwise(0).alias("enrolled_flag"))
    kind = F.col("event_type")
    return e.agg(F.count_if(kind == "click").alias("medical_claims"), F.count_if(kind == "view").alias("pharmacy_fills"), F.sum(F.when(kind == "purchase", F.col("value"))).alias("pharmacy_paid"))


_SUMS = ", ".join(f"coalesce(sum({c}), 0)::DOUBLE AS {c}{{0}}" for c in ("medical_claims", "pharmacy_fills", "pharmacy_paid"))


@query(f"SELECT person_id, {_SUMS.format('_total')}, count(month) AS member_months FROM {_CLAIMS} WHERE enrolled_flag = 1 GROUP BY 1")
def claims_member_rollup(spark, sf):
    return claims.member_rollup(claims.enrolled_member_months(_claims(spark, sf)))


@query(f"SELECT month, {_SUMS.format('')}, count(person_id) AS member_months FROM {_CLAIMS} WHERE enrolled_flag = 1 GROUP BY 1")
def claims_monthly_trend(spark, sf):
    return claims.monthly_trend(claims.enrolled_member_months(_claims(spark, sf)))


# -- functions over rows and groups


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE substr(o_orderpriority, 1, 1) IN ('1', '2') AND o_totalprice > 100000")
def filter_by_function(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    return R.where_rows(o, lambda r: r["o_orderpriority"][0] in "12" and r["o_totalprice"] > 100_000).select("o_orderkey", "o_orderstatus")


@query("SELECT p_size * 2 AS p_size, upper(p_brand) AS p_brand FROM part")
def default_names(spark, sf):
    return table(spark, sf, "part").select(E.apply("p_size", lambda c: E.mul(c, 2)), E.apply("p_brand", E.str_upper))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN -1 ELSE p_size * p_size + 1 END::DOUBLE AS y FROM part")
def map_function(spark, sf):
    holes = F.when(F.col("p_partkey") % 3 != 0, F.col("p_size"))
    return table(spark, sf, "part").select("p_partkey", E.map_values(holes, lambda v: -1.0 if v is None else float(v * v + 1)).alias("y"))


@query("SELECT l_returnflag, trunc(avg(l_quantity))::INT AS whole, sum(l_linenumber)::BIGINT::VARCHAR AS lines FROM lineitem GROUP BY ALL")
def cast_aggregate(spark, sf):
    return A.group(table(spark, sf, "lineitem"), ["l_returnflag"], E.cast(A.mean("l_quantity"), "i32").alias("whole"), E.cast(A.total("l_linenumber").cast("long"), "str").alias("lines"))


@query("SELECT o_orderpriority, max(o_totalprice) - min(o_totalprice) AS spread, count(*) AS n FROM orders GROUP BY ALL")
def iterate_groups(spark, sf):
    import pandas as pd

    def one(key, g):
        return pd.DataFrame({"o_orderpriority": [key[0]], "spread": [g["o_totalprice"].max() - g["o_totalprice"].min()], "n": [len(g)]})

    return A.per_group(table(spark, sf, "orders").select("o_orderpriority", "o_totalprice"), ["o_orderpriority"], one, "o_orderpriority string, spread double, n long")


# -- windows over the whole frame

_V = "CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END"


def _events(spark, sf):
    return table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 9 != 0, F.col("value")).alias("v"))


@query(f"SELECT event_id, lag({_V}) OVER (ORDER BY event_id) AS back, lead({_V}, 2) OVER (ORDER BY event_id) AS ahead FROM events")
def win_shift_global(spark, sf):
    e = ordered.shift(ordered.shift(_events(spark, sf), "back", "v", order_by=["event_id"]), "ahead", "v", -2, order_by=["event_id"])
    return e.select("event_id", "back", "ahead")


@query(f"SELECT event_id, CASE WHEN v IS NOT NULL THEN round(s, 2) END AS total FROM (SELECT event_id, {_V} AS v, sum({_V}) OVER (ORDER BY event_id) AS s FROM events)")
def win_cum_sum_global(spark, sf):
    return ordered.cum_sum(_events(spark, sf), "total", "v", order_by=["event_id"]).select("event_id", F.round("total", 2).alias("total"))


@query(f"SELECT event_id, {_V} - lag({_V}, 3) OVER (ORDER BY event_id) AS d FROM events")
def win_diff_global(spark, sf):
    return ordered.diff(_events(spark, sf), "d", "v", 3, order_by=["event_id"]).select("event_id", "d")


@query(f"SELECT event_id, CASE WHEN row_number() OVER (ORDER BY event_id) >= 5 THEN round(avg({_V}) OVER (ORDER BY event_id ROWS 4 PRECEDING), 6) END AS m FROM events")
def win_rolling_mean_global(spark, sf):
    return ordered.rolling_mean(_events(spark, sf), "m", "v", 5, order_by=["event_id"]).select("event_id", F.round("m", 6).alias("m"))


@query("SELECT p_partkey, CASE WHEN s IS NOT NULL THEN rank() OVER (PARTITION BY s IS NULL ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE END AS r FROM (SELECT p_partkey, CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE p_size END AS s FROM part)")
def win_rank_global(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 8 != 0, F.col("p_size")).alias("s"))
    return ordered.rank(p, "r", "s").select("p_partkey", "r")


# -- panel estimators over a balanced panel: twelve units of users, six periods of five days (the last is longer)

_BALANCED = "(SELECT user_id % 12 AS unit, least((day(ts) - 1) // 5, 5) AS t, avg(value) AS y, CASE WHEN user_id % 12 % 3 = 1 THEN 2 WHEN user_id % 12 % 3 = 2 THEN 4 END AS adopt FROM events GROUP BY ALL)"


def _balanced(spark, sf):
    e = table(spark, sf, "events").groupBy((F.col("user_id") % 12).alias("unit"), F.least(F.floor((F.dayofmonth("ts") - 1) / 5), F.lit(5)).alias("t")).agg(F.avg("value").alias("y"))
    return e.withColumn("adopt", F.when(F.col("unit") % 3 == 1, 2).when(F.col("unit") % 3 == 2, 4))


_DEMEANED = f"(SELECT unit, t, y - avg(y) OVER (PARTITION BY unit) - avg(y) OVER (PARTITION BY t) + avg(y) OVER () AS y, d - avg(d) OVER (PARTITION BY unit) - avg(d) OVER (PARTITION BY t) + avg(d) OVER () AS d FROM (SELECT *, CASE WHEN t >= adopt THEN 1.0 ELSE 0.0 END::DOUBLE AS d FROM {_BALANCED}))"


@query(f"SELECT unit, t, round(y, 8) AS y, round(d, 8) AS d FROM {_DEMEANED}")
def within_transform(spark, sf):
    p = _balanced(spark, sf).withColumn("d", F.coalesce((F.col("t") >= F.col("adopt")).cast("double"), F.lit(0.0)))
    free = ols.within_transform(p, ["y", "d"], "unit", "t")
    clean = lambda c: (F.round(c, 8) + F.lit(0.0)).alias(c)
    return free.select("unit", "t", clean("y"), clean("d"))


@query(f"""
WITH p AS {_DEMEANED}, b AS (SELECT sum(d * y) / sum(d * d) AS att, sum(d * d) AS dd, count(*) AS n FROM p), s AS (SELECT unit, sum(d * (y - att * d)) AS s FROM p, b GROUP BY unit)
SELECT round(any_value(att), 8) AS att, round(sqrt(count(*) / (count(*) - 1.0) * (any_value(n) - 1) / (any_value(n) - 1) * sum(s * s)) / any_value(dd), 8) AS se FROM s, b
""")
def twfe_balanced(spark, sf):
    p = _balanced(spark, sf).withColumn("d", F.coalesce((F.col("t") >= F.col("adopt")).cast("int"), F.lit(0)))
    e = did.twfe(p, "y", "d", "unit", "t")
    return spark.createDataFrame([(round(e.att, 8), round(e.se, 8))], "att double, se double")


@query(f"""
WITH p AS (SELECT unit, t, y, CASE WHEN t - adopt <= -2 THEN 1.0 ELSE 0.0 END::DOUBLE AS a, CASE WHEN t - adopt >= 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS b FROM {_BALANCED}),
w AS (SELECT {", ".join(f"{c} - avg({c}) OVER (PARTITION BY unit) - avg({c}) OVER (PARTITION BY t) + avg({c}) OVER () AS {c}" for c in "yab")} FROM p),
s AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS cy FROM w)
SELECT -2 AS event_time, round((ay * bb - cy * ab) / (aa * bb - ab * ab), 7) AS estimate, (SELECT count(*) FILTER (a = 1) FROM p) AS n FROM s
UNION ALL SELECT 0, round((cy * aa - ay * ab) / (aa * bb - ab * ab), 7), (SELECT count(*) FILTER (b = 1) FROM p) FROM s
UNION ALL SELECT -1, 0.0, (SELECT count(*) FROM {_BALANCED} WHERE t - adopt = -1)
""")
def event_study_balanced(spark, sf):
    r = did.event_study(_balanced(spark, sf), "y", "unit", "t", "adopt", window=(-2, 0))
    return spark.createDataFrame([(x["event_time"], round(x["estimate"], 7), x["n"]) for x in r.effects], "event_time int, estimate double, n long")


_PRE = "(SELECT value AS y, day(ts) AS t, CASE WHEN user_id % 2 = 1 THEN 1 ELSE 0 END AS d FROM events WHERE day(ts) < 16)"


def _users(spark, sf):
    return table(spark, sf, "events").select("value", F.dayofmonth("ts").alias("t"), (F.col("user_id") % 2).cast("int").alias("d"))


@query(f"SELECT round(regr_slope(y, t) FILTER (d = 1) - regr_slope(y, t) FILTER (d = 0), 7) AS slope_difference FROM {_PRE}")
def parallel_trends(spark, sf):
    r = did.check_parallel_trends(_users(spark, sf), "value", "d", "t", 16)
    return spark.createDataFrame([(round(r["slope_difference"], 7),)], "slope_difference double")


@query(f"""
WITH p AS (SELECT y, d, t >= (SELECT list(DISTINCT t ORDER BY t)[count(DISTINCT t) // 2 + 1] FROM {_PRE}) AS post FROM {_PRE}), c AS (SELECT d, post, avg(y) AS m, sum((y - mm) * (y - mm)) AS rss, count(*) AS n FROM (SELECT *, avg(y) OVER (PARTITION BY d, post) AS mm FROM p) GROUP BY d, post)
SELECT round(sum(m * CASE WHEN (d = 1) = post THEN 1 ELSE -1 END), 7) AS att, round(sqrt(sum(n) / (sum(n) - 4.0) * sum(rss / n / n)), 7) AS se FROM c
""")
def placebo(spark, sf):
    e = did.placebo_test(_users(spark, sf), "value", "d", "t", 16)
    return spark.createDataFrame([(round(e.att, 7), round(e.se, 7))], "att double, se double")


@query("""
WITH g AS (SELECT o_orderpriority AS g, sum((x - mx) * (x - mx)) AS xx, sum((x - mx) * (y - my)) AS xy, sum((y - my) * (y - my)) AS yy FROM (SELECT o_orderpriority, o_custkey AS x, o_totalprice AS y, avg(o_custkey) OVER (PARTITION BY o_orderpriority) AS mx, avg(o_totalprice) OVER (PARTITION BY o_orderpriority) AS my FROM orders) GROUP BY 1),
a AS (SELECT regr_syy(o_totalprice, o_custkey) - pow(regr_sxy(o_totalprice, o_custkey), 2) / regr_sxx(o_totalprice, o_custkey) AS red, count(*) AS n FROM orders), f AS (SELECT sum(yy) - pow(sum(xy), 2) / sum(xx) AS ful, count(*) AS k FROM g)
SELECT round(((red - ful) / (k - 1)) / (ful / (n - k - 1)), 5) AS f, (k - 1)::BIGINT AS df1, (n - k - 1)::BIGINT AS df2 FROM a, f
""")
def ancova(spark, sf):
    r = ols.ancova(table(spark, sf, "orders"), "o_totalprice", ["o_custkey"], "o_orderpriority")
    return spark.createDataFrame([(round(r["f"], 5), r["df1"], r["df2"])], "f double, df1 long, df2 long")


@query("SELECT c_mktsegment AS arm, count(*)::VARCHAR AS n, printf('%.1f', avg(c_acctbal)) || ' (' || printf('%.1f', stddev_samp(c_acctbal)) || ')' AS balance FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1")
def table_one_cells(spark, sf):
    c = table(spark, sf, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    rows = {r["row"]: r for r in table_one.table_one(c, "c_mktsegment", ["c_acctbal"]).collect()}
    return spark.createDataFrame([(a, rows[0][a], rows[1][a]) for a in ("BUILDING", "MACHINERY")], "arm string, n string, balance string")


#: Student's t with 2 degrees of freedom has a closed distribution, so its p-values can be put beside SQL.
@query("SELECT x, round(1 - x / sqrt(2 + x * x), 9) AS p, round(1 - exp(-x / 2), 9) AS chi2, round(lgamma(x), 9) AS lg FROM (SELECT i / 4.0::DOUBLE AS x FROM range(1, 41) r(i))")
def special_functions(spark, sf):
    xs = [i / 4 for i in range(1, 41)]
    return spark.createDataFrame([(x, round(special.t_two_sided_p(x, 2), 9), round(special.chi2_cdf(x, 2), 9), round(special.log_gamma(x), 9)) for x in xs], "x double, p double, chi2 double, lg double")


@query("""
SELECT p1, ceil(pow(1.959963984540054 * sqrt(2 * m * (1 - m)) + 0.8416212335729143 * sqrt(p1 * (1 - p1) + p2 * (1 - p2)), 2) / pow(p2 - p1, 2)) AS n, ceil(2 * pow((1.959963984540054 + 0.8416212335729143) * 15 / (100 * p2), 2)) AS n_means
FROM (SELECT i / 20.0::DOUBLE AS p1, i / 20.0::DOUBLE + 0.04 AS p2, i / 20.0::DOUBLE + 0.02 AS m FROM range(1, 16) r(i))
""")
def sample_sizes(spark, sf):
    rows = [(i / 20, float(power.sample_size_two_proportions(i / 20, i / 20 + 0.04)), float(power.sample_size_two_means(0, 100 * (i / 20 + 0.04), 15))) for i in range(1, 16)]
    return spark.createDataFrame(rows, "p1 double, n double, n_means double")


@query("SELECT m::DOUBLE AS m, (1 + (m - 1) * 0.05)::DOUBLE AS deff, round(4.0::DOUBLE / (10 * m) * (1 + (m - 1) * 0.05::DOUBLE), 12) AS clustered FROM range(1, 31) r(m)")
def design_effects(spark, sf):
    return spark.createDataFrame([(float(m), power.design_effect(m, 0.05), round(power.variance_cluster(2, 10, m, 0.05), 12)) for m in range(1, 31)], "m double, deff double, clustered double")


@query("SELECT k::BIGINT AS arms, CASE k WHEN 1 THEN 1.0 WHEN 2 THEN 1.0 WHEN 3 THEN 1.5 WHEN 4 THEN 4 / 3.0::DOUBLE WHEN 5 THEN 1.25 ELSE least(k / 2.0::DOUBLE, 2.0) END::DOUBLE AS factor, round(1 - pow(1 - 0.5 * 0.4 * 0.3, k), 12) AS joint FROM range(1, 9) r(k)")
def arm_factors(spark, sf):
    joint = lambda k: experiment.channel_cascade([{"reach": 0.5, "open": 0.4, "efficacy": 0.3}] * k)["relative_effect"]
    return spark.createDataFrame([(k, float(experiment.multi_arm_adjustment(k)), round(joint(k), 12)) for k in range(1, 9)], "arms long, factor double, joint double")


@query("SELECT round(c / (a * c - b * b), 12) AS i00, round(-b / (a * c - b * b), 12) AS i01, round(a / (a * c - b * b), 12) AS i11 FROM (SELECT count(*)::DOUBLE AS a, sum(p_size)::DOUBLE AS b, sum(p_size * p_size)::DOUBLE AS c FROM part)")
def matrix_inverse(spark, sf):
    r = table(spark, sf, "part").agg(F.count("*").alias("a"), F.sum("p_size").alias("b"), F.sum(F.col("p_size") * F.col("p_size")).alias("c")).first()
    i = matrix.inv(np.array([[r["a"], r["b"]], [r["b"], r["c"]]], dtype=float))
    return spark.createDataFrame([tuple(round(float(x), 12) for x in (i[0, 0], i[0, 1], i[1, 1]))], "i00 double, i01 double, i11 double")


_PEOPLE = "(SELECT user_id, avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END) AS rate, user_id % 10 AS score FROM events GROUP BY user_id)"


@query(f"""
WITH s AS (SELECT CASE WHEN score < 5 THEN 'low' ELSE 'high' END AS stratum, avg(rate) AS base_rate, count(*) AS available FROM {_PEOPLE} GROUP BY 1)
SELECT stratum, round(base_rate, 9) AS base_rate, available FROM s
""")
def design_strata(spark, sf):
    e = table(spark, sf, "events").select("user_id", (F.col("event_type") == "purchase").cast("int").alias("bought"), (F.col("user_id") % 10 < 5).cast("int").alias("low"))
    units = experiment.ExperimentDesign.from_panel(e, "user_id", "bought", risk_score="low").units
    return units.groupBy(F.when(F.col("score") == 1, "low").otherwise("high").alias("stratum")).agg(F.round(F.avg("rate"), 9).alias("base_rate"), F.count("*").alias("available"))


@query("""
WITH c AS (SELECT ceil(1.5 * ceil(pow(1.959963984540054 * sqrt(2 * 0.18 * 0.82) + 0.8416212335729143 * sqrt(0.2 * 0.8 + 0.16 * 0.84), 2) / pow(0.04, 2)))::DOUBLE AS n)
SELECT 'screened' AS stage, NULL::VARCHAR AS arm, 50000.0::DOUBLE AS units UNION ALL SELECT 'left_out', NULL, 50000 - 3 * n FROM c UNION ALL SELECT 'allocated', NULL, 3 * n FROM c UNION ALL SELECT 'planned', unnest(['call', 'mail', 'control']), n FROM c
""")
def experiment_flow(spark, sf):
    design = experiment.ExperimentDesign.from_assumptions().stratify([{"name": "all", "base_rate": 0.2, "available": 50_000}])
    built = design.arms([{"name": "call", "relative_effect": -0.2}, {"name": "mail", "relative_effect": -0.25}]).power(effect_size="pooled").build()
    return built.flow(spark, 50_000).select("stage", "arm", F.round("units", 6).alias("units"))


# -- the figures behind charts


@query("SELECT avg(l_quantity) AS mean, median(l_quantity) AS median, quantile_cont(l_quantity, 0.05) AS p5, quantile_cont(l_quantity, 0.95) AS p95 FROM lineitem")
def distribution_markers(spark, sf):
    m = P.markers(table(spark, sf, "lineitem"), "l_quantity")
    return m.select("mean", "median", F.col("percentiles")[0].alias("p5"), F.col("percentiles")[1].alias("p95"))


@query("WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1) SELECT event_type, value FROM events JOIN q USING (event_type) WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)")
def box_outliers(spark, sf):
    return P.outliers(table(spark, sf, "events"), "value", ["event_type"])


@query("SELECT 'A' AS side, s_acctbal AS bal FROM supplier UNION ALL SELECT 'B', c_acctbal FROM customer")
def two_group_rows(spark, sf):
    return P.two_groups(table(spark, sf, "supplier").select(F.col("s_acctbal").alias("bal")), table(spark, sf, "customer").select(F.col("c_acctbal").alias("bal")), label="side")


@query("SELECT label, estimate, low, high, low > 0 OR high < 0 AS excludes_zero FROM (SELECT event_type AS label, avg(value) - 50 AS estimate, avg(value) - 50 - 20 AS low, avg(value) - 50 + 20 AS high FROM events GROUP BY 1)")
def forest(spark, sf):
    m = F.avg("value") - 50
    return P.forest_rows(A.group(table(spark, sf, "events"), ["event_type"], m.alias("e"), (m - 20).alias("lo"), (m + 20).alias("hi")), "event_type", "e", "lo", "hi")


_STEPS = "(SELECT y, coalesce(sum(v) OVER (ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, sum(v) OVER (ORDER BY y) AS e FROM (SELECT year(o_orderdate) AS y, count(*)::DOUBLE AS v FROM orders GROUP BY 1))"


@query(f"SELECT y::VARCHAR AS label, s::DOUBLE AS start, e::DOUBLE AS end, lag(e) OVER (ORDER BY y)::DOUBLE AS previous_end, (e - s)::DOUBLE AS change FROM {_STEPS}")
def waterfall_steps(spark, sf):
    years = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").cast("double").alias("v"))
    ends = ordered.cum_sum(years, "e", "v", order_by=["y"]).select("y", F.col("y").cast("string").alias("label"), (F.col("e") - F.col("v")).alias("s"), "e")
    return P.waterfall(ends, "label", "s", "e", "y")


@query("""
WITH b AS (SELECT c_mktsegment AS g, count(*) AS n, min(c_acctbal) - 1500 AS x0, (max(c_acctbal) - min(c_acctbal) + 3000) / 19 AS dx FROM customer GROUP BY 1),
d AS (SELECT g, i, x0 + i * dx AS x, sum(exp(-0.5 * pow((x0 + i * dx - c_acctbal) / 500, 2))) AS k FROM b JOIN customer ON c_mktsegment = g, range(20) r(i) GROUP BY g, i, x0, dx)
SELECT g AS c_mktsegment, round(x, 6) AS x, round(k / max(k) OVER (PARTITION BY g), 9) AS density FROM d
""")
def kde_by_normalized(spark, sf):
    k = density.kde(table(spark, sf, "customer"), "c_acctbal", by=["c_mktsegment"], bandwidth=500, n=20, normalize=True)
    return k.select("c_mktsegment", F.round("x", 6).alias("x"), F.round("density", 9).alias("density"))


@query("""
SELECT o_orderstatus, o_orderpriority, CASE WHEN grouping(o_orderstatus) = 1 THEN 0 WHEN grouping(o_orderpriority) = 1 THEN 1 ELSE 2 END AS depth, coalesce(sum(a), 0)::DOUBLE AS a, coalesce(sum(b), 0)::DOUBLE AS b, (coalesce(sum(a), 0) + coalesce(sum(b), 0))::DOUBLE AS total
FROM (SELECT o_orderstatus, o_orderpriority, CASE WHEN o_orderkey % 2 = 0 THEN 1 END AS a, CASE WHEN o_orderkey % 3 = 0 THEN 2 END AS b FROM orders) GROUP BY ROLLUP (o_orderstatus, o_orderpriority)
""")
def sankey_flow(spark, sf):
    o = table(spark, sf, "orders").withColumns({"a": F.when(F.col("o_orderkey") % 2 == 0, 1), "b": F.when(F.col("o_orderkey") % 3 == 0, 2)})
    return P.flow_tree(o, ["o_orderstatus", "o_orderpriority"], ["a", "b"])


@query("""
SELECT r_name, n_name, CASE WHEN grouping(r_name) = 1 THEN 0 WHEN grouping(n_name) = 1 THEN 1 ELSE 2 END AS depth, CASE WHEN count(*) > 0 THEN count(*) FILTER (c_acctbal > 5000) / count(*)::DOUBLE ELSE 0.0 END AS share
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)
""")
def tree_rates(spark, sf):
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    x = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return P.rollup_tree(x, ["r_name", "n_name"], share=P.rate((F.col("c_acctbal") > 5000).cast("int"), F.lit(1)))


@query("""
SELECT event_type AS cohort, n::BIGINT AS n_per_arm, (2 * n)::BIGINT AS total_n, p2 FROM (SELECT event_type, p1 + 0.05 AS p2, ceil(pow(1.6448536269514722 * sqrt(2 * (p1 + 0.025) * (1 - p1 - 0.025)) + 0.8416212335729143 * sqrt(p1 * (1 - p1) + (p1 + 0.05) * (0.95 - p1)), 2) / pow(p1 + 0.05 - p1, 2)) AS n FROM (SELECT event_type, round(count(*) / (SELECT count(*) FROM events)::DOUBLE, 3) AS p1 FROM events GROUP BY 1))
""")
def power_by_cohort(spark, sf):
    e = table(spark, sf, "events")
    every = e.count()
    shares = e.groupBy(F.col("event_type").alias("cohort")).agg(F.round(F.count("*") / F.lit(every), 3).alias("p1")).withColumn("change", F.lit(0.05))
    return P.power_rows(shares, "cohort", "p1", "change")


@query("SELECT o_orderpriority AS label, d AS date, datediff('day', lag(d) OVER (ORDER BY d, o_orderpriority), d)::INTEGER AS days_since_previous FROM (SELECT o_orderpriority, min(o_orderdate) AS d FROM orders GROUP BY 1)")
def first_orders(spark, sf):
    o = A.group(table(spark, sf, "orders"), ["o_orderpriority"], F.min("o_orderdate").cast("string").alias("d"))
    return P.timeline(o, "d", "o_orderpriority")


@query("SELECT c_custkey, printf('%.4f%%', c_acctbal / 100) AS share FROM customer")
def percent_texts(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", M.percent(F.col("c_acctbal") / 10000, 4).alias("share"))


@query("SELECT 'c_name' AS column, 'string' AS dtype, 0.0::DOUBLE AS missing, NULL::DOUBLE AS sd, NULL::DOUBLE AS share_true FROM (SELECT 1) UNION ALL SELECT 'c_acctbal', 'double', count(*) FILTER (c_custkey % 5 = 0) / count(*)::DOUBLE, stddev_samp(CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END), NULL FROM customer UNION ALL SELECT 'rich', 'boolean', 0.0, NULL, avg(CASE WHEN c_acctbal > 5000 THEN 1.0 ELSE 0.0 END) FROM customer")
def summary_shares(spark, sf):
    c = table(spark, sf, "customer").select("c_name", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("c_acctbal"), (F.col("c_acctbal") > 5000).alias("rich"))
    return P.summary_table(c).select("column", "dtype", "missing", "sd", "share_true")


@query("""SELECT * FROM (SELECT 'o_orderpriority' AS "column", o_orderpriority AS "value", count(*) AS "count", row_number() OVER (ORDER BY count(*) DESC, o_orderpriority)::INTEGER AS "rank" FROM orders GROUP BY o_orderpriority) WHERE "rank" <= 3""")
def top_values(spark, sf):
    return P.top_values(table(spark, sf, "orders"), ["o_orderpriority"], 3)
