"""Every registered query of the engine's own operators, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import aggs as A
from ..functions import exprs as E
from ..functions import windows as W
from ..operators import profile as P
from ..operators import quantiles
from ..operators import relational as R
from ..operators import timegroup as T
from ..session import table
from ..sources import claims
from ..stats import density, did, ols, table_one, ttests

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# -- the shapes of the published reference points


@query("SELECT l_shipdate, avg(l_quantity) AS mean FROM lineitem GROUP BY ALL")
def base_group_mean(spark, sf):
    return A.group(table(spark, sf, "lineitem"), ["l_shipdate"], A.mean("l_quantity").alias("mean"))


@query("SELECT l_returnflag, l_linestatus, sum(l_extendedprice) AS total, avg(l_quantity) AS mean, count(l_tax) AS n FROM lineitem GROUP BY ALL")
def base_group_two_keys(spark, sf):
    return A.group(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], A.total("l_extendedprice").alias("total"), A.mean("l_quantity").alias("mean"), A.count("l_tax").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_quantity > 25 AND l_discount < 0.05")
def base_filter_two(spark, sf):
    keep = E.gt(F.col("l_quantity"), 25) & E.lt(F.col("l_discount"), 0.05)
    return R.where(table(spark, sf, "lineitem"), keep).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem")
def base_sort(spark, sf):
    return R.sort(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice", True, ["l_orderkey", "l_linenumber"])


@query("SELECT l_orderkey, l_partkey, l_quantity, p_size FROM lineitem JOIN part ON l_partkey = p_partkey")
def base_join(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_size")
    return R.join(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity"), part, left_on="l_partkey", right_on="p_partkey").drop("p_partkey")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem")
def base_with_column(spark, sf):
    x = R.with_columns(table(spark, sf, "lineitem"), charge=E.mul(E.mul(F.col("l_extendedprice"), E.sub(1, F.col("l_discount"))), E.add(1, F.col("l_tax"))))
    return x.select("l_orderkey", "l_linenumber", "charge")


# -- projection, filters, expressions


@query("""
SELECT o_orderkey, o_custkey, o_totalprice FROM (
  SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
         CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS s FROM orders)
WHERE (CASE WHEN o_custkey IS NULL OR s IS NULL THEN NULL ELSE (o_custkey > 700 OR s = 'F') END)
  AND NOT coalesce(s IN ('P', 'X'), false) AND o_totalprice BETWEEN 1000 AND 200000
""")
def filter_logic_nulls(spark, sf):
    o = table(spark, sf, "orders")
    o = R.with_columns(o, o_custkey=F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")), s=F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")))
    keep = E.either(E.gt(F.col("o_custkey"), 700), E.eq(F.col("s"), "F"))
    out = R.where(R.where(o, keep), E.negate(E.is_in(F.col("s"), ["P", "X"])))
    return R.where(out, E.between(F.col("o_totalprice"), 1000, 200000)).select("o_orderkey", "o_custkey", "o_totalprice")


@query("""
SELECT l_orderkey, l_linenumber, l_extendedprice,
  CASE WHEN q = 0 THEN CASE WHEN p > 0 THEN 'Infinity'::DOUBLE WHEN p < 0 THEN '-Infinity'::DOUBLE ELSE 'NaN'::DOUBLE END ELSE p / q END AS ratio,
  CASE WHEN q = 0 THEN 'NaN'::DOUBLE ELSE p % q END AS rest,
  CASE WHEN l_discount > 0 THEN ln(l_discount) ELSE '-Infinity'::DOUBLE END AS lg, floor(-l_tax * 100 / 4 * 10 + 0.5) / 10 AS r, sqrt(l_quantity) AS sq, pow(l_discount, 2) AS pw, -l_tax AS ng, abs(p) AS ab, exp(l_discount) AS ex
FROM (SELECT *, l_extendedprice - 30000 AS p, l_quantity - 25 AS q FROM lineitem)
""")
def scalar_math(spark, sf):
    x = table(spark, sf, "lineitem").withColumns({"p": E.sub(F.col("l_extendedprice"), 30000), "q": E.sub(F.col("l_quantity"), 25)})
    p, q, d = F.col("p"), F.col("q"), F.col("l_discount")
    # the ELSE branches of the SQL also take nulls, and its NaN is above 0
    ratio = F.when((q == 0) & F.isnan(p), E.INF).otherwise(F.coalesce(E.div(p, q), F.when(q == 0, E.NAN)))
    rest, lg = F.coalesce(E.mod(p, q), F.when(q == 0, E.NAN)), F.coalesce(E.log(F.when(d > 0, d)), F.lit(-E.INF))
    return x.select("l_orderkey", "l_linenumber", "l_extendedprice", ratio.alias("ratio"), rest.alias("rest"), lg.alias("lg"), E.round_half_up(E.div(E.mul(E.neg(F.col("l_tax")), 100), 4), 1).alias("r"), E.sqrt(F.col("l_quantity")).alias("sq"), E.power(d, 2).alias("pw"), E.neg(F.col("l_tax")).alias("ng"), E.absolute(p).alias("ab"), E.exp(d).alias("ex"))


@query("""
SELECT c_custkey, lower(c_name) AS low, upper(c_mktsegment) AS up, length(c_name)::DOUBLE AS n, contains(c_name, '99') AS has, regexp_matches(c_name, '0[1-3]$') AS re,
       starts_with(c_name, 'Customer#') AS st, ends_with(c_mktsegment, 'E') AS en, replace(c_name, '0', 'o') AS rep, regexp_replace(c_name, '[0-9]+', '#', 'g') AS rex,
       trim(c_mktsegment) AS strip, substr(c_name, 3, 4) AS sl, right(c_name, 3) AS tl, coalesce(contains(CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END, 'C'), false) AS nul
FROM customer
""")
def scalar_string(spark, sf):
    import re

    n, m = F.col("c_name"), F.col("c_mktsegment")
    holes = F.when(F.col("c_custkey") % 3 != 0, n)
    return table(spark, sf, "customer").select("c_custkey", E.str_lower(n).alias("low"), E.str_upper(m).alias("up"), E.str_len(n).alias("n"), E.str_contains(n, "99").alias("has"), E.str_contains(n, re.compile("0[1-3]$")).alias("re"), E.str_starts_with(n, "Customer#").alias("st"), E.str_ends_with(m, "E").alias("en"), E.str_replace(n, "0", "o").alias("rep"), E.str_replace(n, re.compile("[0-9]+"), "#").alias("rex"), E.str_strip(F.concat(F.lit(" \t"), m, F.lit(" \n"))).alias("strip"), E.str_slice(n, 2, 6).alias("sl"), E.str_slice(n, -3).alias("tl"), E.str_contains(holes, "C").alias("nul"))


@query("""
SELECT event_id, year(ts)::DOUBLE AS y, month(ts)::DOUBLE AS mo, day(ts)::DOUBLE AS d, hour(ts)::DOUBLE AS h, dayofweek(ts)::DOUBLE AS wd FROM events
""")
def scalar_date(spark, sf):
    c = F.col("ts")
    return table(spark, sf, "events").select("event_id", E.dt_year(c).alias("y"), E.dt_month(c).alias("mo"), E.dt_day(c).alias("d"), E.dt_hour(c).alias("h"), E.dt_weekday(c).alias("wd"))


@query("""
SELECT p_partkey, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS size_class, coalesce(CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size END, -1) AS filled,
       p_retailprice::VARCHAR IS NOT NULL AS has_text, TRY_CAST(split_part(p_name, ' ', 1) AS DOUBLE) AS num, trunc(p_retailprice)::INT AS whole FROM part
""")
def when_fillnull_cast(spark, sf):
    p = table(spark, sf, "part")
    holes = F.when(F.col("p_partkey") % 4 != 0, F.col("p_size"))
    return p.select("p_partkey", E.when(E.gt(F.col("p_size"), 25), "big", "small").alias("size_class"), E.fill_null(holes, -1).alias("filled"), E.is_not_null(E.cast(F.col("p_retailprice"), "str")).alias("has_text"), E.cast(F.split("p_name", " ")[0], "f64").alias("num"), E.cast(F.col("p_retailprice"), "i32").alias("whole"))


@query("SELECT o_orderkey, o_totalprice / avg(o_totalprice) OVER () AS share, max(o_totalprice) OVER () AS top FROM orders")
def select_broadcast_agg(spark, sf):
    o = R.with_aggregates(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), m=A.mean("o_totalprice"), top=A.maximum("o_totalprice"))
    return o.select("o_orderkey", E.div(F.col("o_totalprice"), F.col("m")).alias("share"), "top")


@query("SELECT count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS a FROM orders) WHERE a IS NOT NULL")
def drop_nulls(spark, sf):
    o = table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("a"), "o_orderkey")
    return R.drop_nulls(R.drop(R.rename(o, {"o_orderkey": "k", "unknown": "x"}), "k", "nothing"), ["a"]).agg(F.count("*").alias("n"))


# -- aggregation


@query("""
SELECT l_returnflag, l_linestatus, coalesce(sum(l_quantity), 0) AS sum_qty, avg(l_extendedprice) AS avg_price, min(l_shipdate) AS first_ship, max(l_discount) AS max_disc, count(l_tax) AS n, stddev_samp(l_quantity) AS sd, var_samp(l_discount) AS v
FROM lineitem WHERE l_quantity > 25 GROUP BY ALL
""")
def agg_basic(spark, sf):
    x = R.where(table(spark, sf, "lineitem"), E.gt(F.col("l_quantity"), 25))
    out = A.group(x, ["l_returnflag", "l_linestatus"], A.total("l_quantity").alias("sum_qty"), A.mean("l_extendedprice").alias("avg_price"), A.minimum("l_shipdate").alias("first_ship"), A.maximum("l_discount").alias("max_disc"), A.count("l_tax").alias("n"), A.std("l_quantity").alias("sd"), A.var("l_discount").alias("v"))
    return R.sort(out, ["l_returnflag", "l_linestatus"])


@query("SELECT l_shipdate, median(l_extendedprice) AS med, quantile_cont(l_quantity, 0.9) AS q90 FROM lineitem GROUP BY ALL")
def agg_quantiles(spark, sf):
    return A.group(table(spark, sf, "lineitem"), ["l_shipdate"], A.median("l_extendedprice").alias("med"), A.quantile("l_quantity", 0.9).alias("q90"))


@query("SELECT o_orderpriority, count(*) AS n, quantile_cont(o_totalprice, 0.1) AS q10, median(o_totalprice) AS q50, quantile_cont(o_totalprice, 0.99) AS q99 FROM orders GROUP BY ALL")
def exact_quantiles(spark, sf):
    q = quantiles.exact_quantiles(table(spark, sf, "orders"), "o_totalprice", [0.1, 0.5, 0.99], ["o_orderpriority"])
    return q.select("o_orderpriority", "n", *(F.col("q")[i].alias(n) for i, n in enumerate(("q10", "q50", "q99"))))


@query("""
SELECT user_id, count(DISTINCT event_type) AS kinds, arg_min(event_type, event_id) FILTER (event_type <> 'click') AS first_kind, arg_max(value, event_id) AS last_value
FROM events GROUP BY ALL
""")
def agg_nunique_first_last(spark, sf):
    e = table(spark, sf, "events")
    other = F.when(F.col("event_type") != "click", F.col("event_type"))
    return A.group(e, ["user_id"], A.n_unique("event_type").alias("kinds"), A.first_by(other, "event_id").alias("first_kind"), A.last_by("value", "event_id").alias("last_value"))


@query("SELECT l_returnflag, sum(l_extendedprice * (1 - l_discount)) / sum(l_quantity) AS per_unit, max(l_tax) - min(l_tax) AS spread FROM lineitem GROUP BY ALL")
def agg_ratio(spark, sf):
    return A.group(table(spark, sf, "lineitem"), ["l_returnflag"], E.div(A.total(E.mul(F.col("l_extendedprice"), E.sub(1, F.col("l_discount")))), A.total("l_quantity")).alias("per_unit"), E.sub(A.maximum("l_tax"), A.minimum("l_tax")).alias("spread"))


@query("SELECT o_custkey, array_to_string(list(o_orderkey ORDER BY o_orderkey), ',') AS keys FROM orders GROUP BY ALL")
def implode(spark, sf):
    return A.group(table(spark, sf, "orders"), ["o_custkey"], A.implode("o_orderkey", "o_orderkey").alias("k")).select("o_custkey", F.array_join(F.col("k").cast("array<string>"), ",").alias("keys"))


@query("SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY ALL")
def group_count(spark, sf):
    return A.group_count(table(spark, sf, "orders"), ["o_orderpriority"])


@query("SELECT coalesce(sum(o_totalprice), 0) AS total, count(o_orderkey) AS n, median(o_totalprice) AS med FROM orders")
def whole_frame_agg(spark, sf):
    return A.aggregate(table(spark, sf, "orders"), A.total("o_totalprice").alias("total"), A.count("o_orderkey").alias("n"), A.median("o_totalprice").alias("med"))


@query("SELECT CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderstatus END AS s, count(CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderstatus END) AS count FROM orders GROUP BY 1")
def value_counts(spark, sf):
    return P.value_counts(table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderstatus")).alias("s")), "s")


_DESCRIBED = ("p_size", "p_retailprice")


@query("\nUNION ALL\n".join(f"SELECT '{label}' AS statistic, " + ", ".join(f"({expr.replace('X', c)})::DOUBLE AS {c}" for c in _DESCRIBED) + " FROM part" for label, expr in (("count", "count(X)"), ("null_count", "count(*) - count(X)"), ("mean", "avg(X)"), ("std", "stddev_samp(X)"), ("min", "min(X)"), ("25%", "quantile_cont(X, 0.25)"), ("50%", "quantile_cont(X, 0.5)"), ("75%", "quantile_cont(X, 0.75)"), ("max", "max(X)"))))
def describe(spark, sf):
    return P.describe(table(spark, sf, "part").select(*_DESCRIBED, "p_name"))


@query("SELECT corr(l_quantity, l_extendedprice) AS corr FROM lineitem WHERE l_linenumber % 3 <> 0")
def corr(spark, sf):
    x = table(spark, sf, "lineitem").withColumn("q", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity")))
    return P.corr(x, "q", "l_extendedprice")


_NUM = ("l_quantity", "l_extendedprice", "l_discount")


@query("\nUNION ALL\n".join(f"SELECT '{a}' AS a, '{b}' AS b, {'max(1.0::DOUBLE)' if a == b else f'corr({min(a, b)}, {max(a, b)})'} AS corr FROM lineitem" for a in _NUM for b in _NUM))
def corr_matrix(spark, sf):
    return P.corr_matrix(table(spark, sf, "lineitem"), _NUM)


# -- windows

_BY_USER = {"order_by": "event_id", "keys": ["user_id"]}
_V = "CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END"
_OVER = "(PARTITION BY user_id ORDER BY event_id"


def _events(spark, sf):
    return table(spark, sf, "events").withColumn("v", F.when(F.col("event_id") % 9 != 0, F.col("value")))


@query(f"SELECT event_id, lag({_V}) OVER {_OVER}) AS back, lead({_V}, 2) OVER {_OVER}) AS ahead FROM events")
def win_shift(spark, sf):
    return _events(spark, sf).select("event_id", W.shift("v", **_BY_USER).alias("back"), W.shift("v", -2, **_BY_USER).alias("ahead"))


@query(f"SELECT event_id, CASE WHEN v IS NOT NULL THEN round(s, 6) END AS total FROM (SELECT event_id, {_V} AS v, sum({_V}) OVER {_OVER}) AS s FROM events)")
def win_cum_sum(spark, sf):
    return _events(spark, sf).select("event_id", F.round(W.cum_sum("v", **_BY_USER), 6).alias("total"))


@query(f"SELECT event_id, {_V} - lag({_V}) OVER {_OVER}) AS d1, {_V} - lead({_V}) OVER {_OVER}) AS dn FROM events")
def win_diff(spark, sf):
    return _events(spark, sf).select("event_id", W.diff("v", **_BY_USER).alias("d1"), W.diff("v", -1, **_BY_USER).alias("dn"))


@query(f"SELECT event_id, CASE WHEN row_number() OVER {_OVER}) >= 3 THEN round(avg({_V}) OVER {_OVER} ROWS 2 PRECEDING), 6) END AS m3 FROM events")
def win_rolling_mean(spark, sf):
    return _events(spark, sf).select("event_id", F.round(W.rolling_mean("v", 3, **_BY_USER), 6).alias("m3"))


@query("""
SELECT p_partkey, CASE WHEN s IS NOT NULL THEN rank() OVER (PARTITION BY p_brand, s IS NULL ORDER BY s) + (count(*) OVER (PARTITION BY p_brand, s) - 1) / 2.0::DOUBLE END AS r
FROM (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE p_size END AS s FROM part)
""")
def win_rank(spark, sf):
    p = table(spark, sf, "part").withColumn("s", F.when(F.col("p_partkey") % 8 != 0, F.col("p_size")))
    return p.select("p_partkey", W.rank("s", keys=["p_brand"]).alias("r"))


# -- time windows


def _n():
    return F.count("*").alias("n")


def _v():
    return F.sum("value").alias("v")


@query("SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS o_orderdate, count(*) AS n, sum(o_totalprice) AS v FROM orders GROUP BY 1")
def dyn_month(spark, sf):
    return T.group_by_dynamic(table(spark, sf, "orders"), "o_orderdate", "1mo", F.count("*").alias("n"), F.sum("o_totalprice").alias("v"))


@query("SELECT date_trunc('quarter', o_orderdate)::TIMESTAMP AS o_orderdate, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2")
def dyn_quarter_by(spark, sf):
    return T.group_by_dynamic(table(spark, sf, "orders"), "o_orderdate", "1q", F.count("*").alias("n"), by=["o_orderstatus"])


@query("SELECT make_timestamp((epoch_us(ts) // 604800000000) * 604800000000) AS ts, count(*) AS n, sum(value) AS v FROM events GROUP BY 1")
def dyn_week(spark, sf):
    return T.group_by_dynamic(table(spark, sf, "events"), "ts", "1w", _n(), _v())


@query("SELECT make_timestamp(((epoch_us(ts) // 21600000000) - j) * 21600000000) AS ts, count(*) AS n, sum(value) AS v FROM events, (SELECT unnest([0, 1, 2, 3]) AS j) GROUP BY 1")
def dyn_sliding(spark, sf):
    return T.group_by_dynamic(table(spark, sf, "events"), "ts", "6h", _n(), _v(), period="1d")


@query("SELECT make_timestamp(((epoch_us(ts) - 7200000000 - 1) // 43200000000) * 43200000000 + 7200000000) AS ts, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def dyn_offset_closed_right(spark, sf):
    return T.group_by_dynamic(table(spark, sf, "events"), "ts", "12h", _n(), offset="2h", closed="right", by=["event_type"])


@query("SELECT make_timestamp((epoch_us(ts) // 86400000000) * 86400000000) AS ts, count(*) AS n FROM events WHERE epoch_us(ts) % 86400000000 < 21600000000 GROUP BY 1")
def dyn_gapped(spark, sf):
    return T.group_by_dynamic(table(spark, sf, "events"), "ts", "1d", _n(), period="6h")


@query("SELECT (l_quantity - 2 - j * 5 - ((l_quantity - 2)::BIGINT % 5 + 5) % 5 + 2)::DOUBLE AS l_quantity, count(*) AS n FROM lineitem, (SELECT unnest([0, 1]) AS j) GROUP BY 1")
def dyn_numeric(spark, sf):
    return T.group_by_dynamic(table(spark, sf, "lineitem"), "l_quantity", 5, F.count("*").alias("n"), period=10, offset=2)


@query("""
SELECT s AS o_orderdate, count(*) AS n FROM (SELECT unnest(CASE WHEN o_orderdate = date_trunc('month', o_orderdate) THEN [date_trunc('month', o_orderdate)::TIMESTAMP, (date_trunc('month', o_orderdate) - INTERVAL 1 MONTH)::TIMESTAMP] ELSE [date_trunc('month', o_orderdate)::TIMESTAMP] END) AS s FROM orders) GROUP BY 1
""")
def dyn_closed_both(spark, sf):
    return T.group_by_dynamic(table(spark, sf, "orders"), "o_orderdate", "1mo", F.count("*").alias("n"), closed="both")


# -- joins, order, shape

# whole tables: orders without lines and keys that are null on either side leave rows unmatched
_OL = "(SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END AS k, o_orderkey, o_orderstatus FROM orders) o {how} JOIN (SELECT CASE WHEN l_orderkey % 3 = 0 THEN l_orderkey END AS k, l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey) l ON o.k = l.k"


def _sides(spark, sf):
    key = lambda c, n: F.when(F.col(c) % n == 0, F.col(c)).alias("k")
    o = table(spark, sf, "orders").select(key("o_orderkey", 2), "o_orderkey", "o_orderstatus")
    return o, table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q")).select(key("l_orderkey", 3), "l_orderkey", "q")


for _name, _how, _sql in (("inner", "inner", ""), ("left", "left", "LEFT"), ("right", "right", "RIGHT"), ("outer", "outer", "FULL")):

    def _join(spark, sf, how=_how):
        left, right = _sides(spark, sf)
        return R.join(left, right, on="k", how=how)

    _join.__name__ = f"join_{_name}"
    query("SELECT coalesce(o.k, l.k) AS k, o_orderkey, o_orderstatus, l_orderkey, q FROM " + _OL.format(how=_sql))(_join)


@query("""
SELECT d.doc_id, d.lang, l.doc_id AS id, l.quality, l.lang AS lang_right FROM documents d JOIN (SELECT doc_id, quality, 'x' AS lang FROM labels) l ON d.doc_id = l.doc_id
""")
def join_suffix(spark, sf):
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality", F.lit("x").alias("lang"))
    return R.join(table(spark, sf, "documents").select("doc_id", "lang"), labels, left_on="doc_id", right_on="id")


@query("SELECT a.k1, a.k2, n, m FROM (SELECT c_nationkey AS k1, c_mktsegment AS k2, count(*) AS n FROM customer GROUP BY ALL) a JOIN (SELECT c_nationkey AS k1, c_mktsegment AS k2, max(c_acctbal) AS m FROM customer WHERE c_acctbal > 5000 GROUP BY ALL) b ON a.k1 = b.k1 AND a.k2 = b.k2")
def join_multi_key(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k1"), F.col("c_mktsegment").alias("k2"), "c_acctbal")
    a = A.group(c, ["k1", "k2"], F.count("*").alias("n"))
    return R.join(a, A.group(c.where("c_acctbal > 5000"), ["k1", "k2"], F.max("c_acctbal").alias("m")), on=["k1", "k2"])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100")
def sort_topk(spark, sf):
    return R.top_k(table(spark, sf, "orders"), 100, "o_totalprice", True, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("""
(SELECT 'head' AS part, o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7) UNION ALL (SELECT 'tail', o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 7)
UNION ALL (SELECT 'slice', o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5 OFFSET 10)
""")
def head_tail_slice(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    parts = {"head": R.head(o, 7, order_by=["o_orderkey"]), "tail": R.tail(o, 7, order_by=["o_orderkey"]), "slice": R.slice_rows(o, 10, 15, order_by=["o_orderkey"])}
    return R.concat(*(x.select(F.lit(k).alias("part"), "o_orderkey") for k, x in parts.items()))


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def unique_first(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    return R.unique(e, ["user_id", "event_type"], order_by=["event_id"])


@query("SELECT n_nationkey AS k, n_name AS name, NULL::INTEGER AS extra FROM nation UNION ALL SELECT r_regionkey, r_name, 1 FROM region")
def concat(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return R.concat(n, table(spark, sf, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"), F.lit(1).alias("extra")))


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS d FROM (SELECT event_id FROM events LIMIT 250)")
def sample_exact(spark, sf):
    s = R.sample(table(spark, sf, "events").select("event_id"), 250, seed=42, order_by=["event_id"])
    return s.agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("d"))


@query("""
SELECT l_returnflag, sum(l_quantity) FILTER (l_linestatus = 'F') AS "F", sum(l_quantity) FILTER (l_linestatus = 'O') AS "O" FROM lineitem GROUP BY ALL
""")
def pivot_sum(spark, sf):
    return R.pivot(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity", "sum", labels=["F", "O"])


@query("""
SELECT user_id, arg_min(value, event_id) FILTER (event_type = 'view') AS view, arg_min(value, event_id) FILTER (event_type = 'click') AS click FROM events GROUP BY ALL
""")
def pivot_first(spark, sf):
    return R.pivot(table(spark, sf, "events"), "user_id", "event_type", "value", labels=["view", "click"], order_by="event_id")


@query("""
SELECT p_partkey, 'p_size' AS variable, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size END::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part
""")
def melt(spark, sf):
    p = table(spark, sf, "part").withColumn("p_size", F.when(F.col("p_partkey") % 5 != 0, F.col("p_size")))
    return R.melt(p, ["p_partkey"], ["p_size", "p_retailprice"])


# -- statistics


@query("""
SELECT count(value) AS n, avg(value) AS mean, (avg(value) - 50) / (stddev_samp(value) / sqrt(count(value))) AS t FROM events
""")
def ttest_one_sample(spark, sf):
    r = ttests.one_sample(table(spark, sf, "events"), "value", 50)
    return spark.createDataFrame([(r.ns[0], r.means[0], r.t)], "n long, mean double, t double")


_TWO = "SELECT avg(c_acctbal) FILTER (g = 'BUILDING') AS m1, avg(c_acctbal) FILTER (g = 'MACHINERY') AS m2, var_samp(c_acctbal) FILTER (g = 'BUILDING') AS v1, var_samp(c_acctbal) FILTER (g = 'MACHINERY') AS v2, count(*) FILTER (g = 'BUILDING') AS n1, count(*) FILTER (g = 'MACHINERY') AS n2 FROM (SELECT *, c_mktsegment AS g FROM customer)"


@query(f"SELECT (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t, pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS df FROM ({_TWO})")
def ttest_welch(spark, sf):
    r = ttests.welch(table(spark, sf, "customer"), "c_acctbal", "c_mktsegment", "BUILDING", "MACHINERY")
    return spark.createDataFrame([(r.t, r.df)], "t double, df double")


@query(f"SELECT (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) AS t, (n1 + n2 - 2)::DOUBLE AS df FROM ({_TWO})")
def ttest_pooled(spark, sf):
    r = ttests.two_sample(table(spark, sf, "customer"), "c_acctbal", "c_mktsegment", "BUILDING", "MACHINERY")
    return spark.createDataFrame([(r.t, float(r.df))], "t double, df double")


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 9) AS r2 FROM lineitem")
def ols_simple(spark, sf):
    f = ols.ols(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"])
    return spark.createDataFrame([(round(float(f.beta[1]), 6), round(float(f.beta[0]), 4), round(f.r2, 9))], "slope double, intercept double, r2 double")


def _panel(spark, sf):
    """Value by user and day, adoption by user: a third never, the others on day 10 or 20."""
    e = table(spark, sf, "events").groupBy("user_id", F.dayofmonth("ts").alias("day")).agg(F.avg("value").alias("y"))
    return e.withColumn("adopt", F.when(F.col("user_id") % 3 == 1, 10).when(F.col("user_id") % 3 == 2, 20))


_PANEL = "(SELECT user_id, day(ts) AS day, avg(value) AS y, CASE user_id % 3 WHEN 1 THEN 10 WHEN 2 THEN 20 END AS adopt FROM events GROUP BY ALL)"


@query(f"""
SELECT round(avg(y) FILTER (t AND p) - avg(y) FILTER (t AND NOT p) - avg(y) FILTER (NOT t AND p) + avg(y) FILTER (NOT t AND NOT p), 6) AS att
FROM (SELECT y, adopt IS NOT NULL AS t, day >= 10 AS p FROM {_PANEL})
""")
def did_2x2(spark, sf):
    p = _panel(spark, sf).withColumns({"t": (F.col("adopt").isNotNull()).cast("int"), "post": (F.col("day") >= 10).cast("int")})
    return spark.createDataFrame([(round(did.did(p, "y", "t", "post", cluster="user_id").att, 6),)], "att double")


@query()
def twfe(spark, sf):
    p = _panel(spark, sf).withColumn("d", F.coalesce((F.col("day") >= F.col("adopt")).cast("int"), F.lit(0)))
    e = did.twfe(p, "y", "d", "user_id", "day")
    return spark.createDataFrame([(e.att, e.se, e.p)], "att double, se double, p double")


@query()
def event_study(spark, sf):
    r = did.event_study(_panel(spark, sf), "y", "user_id", "day", "adopt", window=(-5, 5))
    return spark.createDataFrame([(x["event_time"], x["estimate"], x["se"], x["n"]) for x in r.effects], "event_time int, estimate double, se double, n long")


@query(f"""
WITH p AS {_PANEL}, times AS (SELECT DISTINCT day FROM p), cells AS (SELECT g, t.day, CASE WHEN t.day >= g THEN (SELECT max(day) FROM times WHERE day < g) ELSE (SELECT max(day) FROM times x WHERE x.day < t.day) END AS base FROM times t, (SELECT DISTINCT adopt AS g FROM p WHERE adopt IS NOT NULL)),
d AS (SELECT c.g, c.day, a.adopt = c.g AS treated, a.y - b.y AS delta FROM cells c JOIN p a ON a.day = c.day AND (a.adopt = c.g OR a.adopt IS NULL) JOIN p b ON b.user_id = a.user_id AND b.day = c.base WHERE c.day <> (SELECT max(day) FROM times WHERE day < c.g))
SELECT g::DOUBLE AS "group", day::DOUBLE AS "time", round(avg(delta) FILTER (treated) - avg(delta) FILTER (treated IS NULL), 6) AS att, count(*) FILTER (treated) AS n_treated, count(*) FILTER (treated IS NULL) AS n_control
FROM d GROUP BY 1, 2 HAVING count(*) FILTER (treated) >= 2 AND count(*) FILTER (treated IS NULL) >= 2
""")
def group_time_att(spark, sf):
    r = did.callaway_santanna(_panel(spark, sf), "y", "user_id", "day", "adopt")
    return spark.createDataFrame([(c["group"], c["time"], round(c["att"], 6), c["n_treated"], c["n_control"]) for c in r.attgt], "group double, time double, att double, n_treated long, n_control long")


@query("SELECT l_returnflag AS arm, l_linestatus AS level, count(*) AS n FROM lineitem GROUP BY ALL")
def table_one_counts(spark, sf):
    return table_one.categorical_counts(table(spark, sf, "lineitem"), "l_returnflag", ["l_linestatus"]).drop("variable")


@query("SELECT c_mktsegment AS arm, count(c_acctbal) AS n, avg(c_acctbal) AS mean, stddev_samp(c_acctbal) AS sd FROM customer GROUP BY ALL")
def table_one_means(spark, sf):
    return table_one.continuous_stats(table(spark, sf, "customer"), "c_mktsegment", ["c_acctbal"]).select("arm", "n", "mean", "sd")


@query("""
WITH b AS (SELECT count(*) AS n, min(s_acctbal) - 3 * 500 AS x0, (max(s_acctbal) - min(s_acctbal) + 6 * 500) / 49 AS dx FROM supplier)
SELECT round(x0 + i * dx, 6) AS x, round(sum(exp(-0.5 * pow((x0 + i * dx - s_acctbal) / 500, 2))) / (n * 500 * 2.5066282746310002) * 1e6, 6) AS density FROM b, range(50) r(i), supplier GROUP BY i, x0, dx, n
""")
def kde_grid(spark, sf):
    k = density.kde(table(spark, sf, "supplier"), "s_acctbal", bandwidth=500, n=50)
    return k.select(F.round("x", 6).alias("x"), F.round(F.col("density") * 1e6, 6).alias("density"))


# -- figures


@query("""
SELECT b AS bin, lo + b * w AS low, lo + (b + 1) * w AS high, count(l_extendedprice) AS count FROM (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 30 AS w FROM lineitem), (SELECT range::INT AS b FROM range(30))
LEFT JOIN lineitem ON least(floor((l_extendedprice - lo) / w), 29)::INT = b GROUP BY ALL
""")
def histogram(spark, sf):
    return P.histogram(table(spark, sf, "lineitem"), "l_extendedprice")


@query("""
WITH q AS (SELECT c_mktsegment, count(*) AS n, quantile_cont(c_acctbal, 0.25) AS q1, median(c_acctbal) AS median, quantile_cont(c_acctbal, 0.75) AS q3 FROM customer GROUP BY ALL)
SELECT q.*, min(c_acctbal) AS low_whisker, max(c_acctbal) AS high_whisker FROM q JOIN customer USING (c_mktsegment) WHERE c_acctbal BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL
""")
def box_stats(spark, sf):
    return P.box_stats(table(spark, sf, "customer"), "c_acctbal", ["c_mktsegment"])


@query("""
SELECT o_orderstatus AS stage, n::DOUBLE AS value, n::DOUBLE / lag(n) OVER (ORDER BY o_orderstatus) AS of_previous, n::DOUBLE / first_value(n) OVER (ORDER BY o_orderstatus) AS of_first, n::DOUBLE / max(n) OVER () AS of_largest FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)
""")
def funnel(spark, sf):
    return P.funnel(A.group(table(spark, sf, "orders"), ["o_orderstatus"], F.count("*").alias("n")), "o_orderstatus", "n", "o_orderstatus")


@query("""
SELECT y, o_orderpriority, v, rank FROM (SELECT *, (row_number() OVER (PARTITION BY y ORDER BY v DESC, o_orderpriority))::INTEGER AS rank FROM (SELECT year(o_orderdate) AS y, o_orderpriority, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2))
WHERE true QUALIFY min(rank) OVER (PARTITION BY o_orderpriority) <= 2
""")
def bump_ranks(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.year("o_orderdate").cast("long").alias("y"), "o_orderpriority").agg(F.sum("o_totalprice").alias("v"))
    return P.bump_ranks(o, "y", "v", "o_orderpriority", top_n=2).select("y", "o_orderpriority", "v", "rank")


@query("""
SELECT r_name, n_name, c_mktsegment, (CASE WHEN grouping(r_name) = 1 THEN 0 WHEN grouping(n_name) = 1 THEN 1 WHEN grouping(c_mktsegment) = 1 THEN 2 ELSE 3 END) AS depth, count(*) AS n, sum(c_acctbal) AS bal
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment)
""")
def rollup_tree(spark, sf):
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    x = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])
    return P.rollup_tree(x, ["r_name", "n_name", "c_mktsegment"], n=F.count("*"), bal=F.sum("c_acctbal"))


@query("SELECT event_type, count(*) AS count, (count(*) // 100)::BIGINT AS dots FROM events GROUP BY 1")
def dot_counts(spark, sf):
    return P.dot_counts(table(spark, sf, "events"), "event_type", 100)


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) WHERE i % 10 = 0")
def every_nth(spark, sf):
    return P.every_nth(table(spark, sf, "events").select("event_id"), 10, ["event_id"])


@query("""
SELECT 'p_size' AS column, avg(p_size) AS mean, quantile_disc(-p_size::DOUBLE, 0.5) * -1 AS median, NULL::BIGINT AS n_distinct FROM part UNION ALL SELECT 'p_brand', NULL, NULL, count(DISTINCT p_brand) FROM part
""")
def summary_table(spark, sf):
    return P.summary_table(table(spark, sf, "part").select("p_size", "p_brand")).select("column", "mean", "median", "n_distinct")


@query("""
SELECT avg(y) FILTER (t AND NOT p) AS treated_pre, avg(y) FILTER (t AND p) AS treated_post, avg(y) FILTER (NOT t AND NOT p) AS control_pre, avg(y) FILTER (NOT t AND p) AS control_post,
       avg(y) FILTER (t AND NOT p) + avg(y) FILTER (NOT t AND p) - avg(y) FILTER (NOT t AND NOT p) AS counterfactual,
       avg(y) FILTER (t AND p) - (avg(y) FILTER (t AND NOT p) + avg(y) FILTER (NOT t AND p) - avg(y) FILTER (NOT t AND NOT p)) AS att
FROM (SELECT value AS y, user_id % 2 = 1 AS t, day(ts) > 15 AS p FROM events)
""")
def did_means(spark, sf):
    e = table(spark, sf, "events").select("value", (F.col("user_id") % 2).alias("t"), (F.dayofmonth("ts") > 15).alias("p"))
    return P.did_means(e, "value", "t", "p")


# -- claims


@query()
def claims_rollup(spark, sf):
    panel = claims.simulate_claims_panel(spark, claims.PanelOptions())
    return claims.member_rollup(claims.enrolled_member_months(panel))


@query()
def claims_trend(spark, sf):
    return claims.monthly_trend(claims.enrolled_member_months(claims.simulate_claims_panel(spark, claims.PanelOptions())))
