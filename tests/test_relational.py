"""Windows, joins, order, reshaping, time windows, CSV and profiles on the small fixtures."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from granary.functions import aggs as A
from granary.functions import windows as W
from granary.operators import profile as P
from granary.operators import relational as R
from granary.operators import timegroup as T
from granary.sources import csv as C
from granary.sources import frames
from granary.sources.random import Mulberry


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


@pytest.fixture(scope="module")
def panel(spark):
    data = [(0, "A", 1, 100), (1, "B", 1, 400), (2, "A", 2, 250), (3, "B", 2, 100), (4, "B", 3, -60)]
    return spark.createDataFrame(data, "i int, member string, month int, paid int")


def test_windows_within_keys(panel):
    at = {"order_by": "month", "keys": ["member"]}
    got = rows(panel.select("i", W.shift("paid", **at), W.diff("paid", **at), W.cum_sum("paid", **at), W.rolling_mean("paid", 2, **at)), "i")
    assert [r[1] for r in got] == [None, None, 100, 400, 100]
    assert [r[2] for r in got] == [None, None, 150.0, -300.0, -160.0]
    assert [r[3] for r in got] == [100.0, 400.0, 350.0, 500.0, 440.0]
    assert [r[4] for r in got] == [None, None, 175.0, 250.0, 20.0]


def test_rank_and_null_keys(spark):
    df = spark.createDataFrame([(0, "a", 3), (1, "b", 9), (2, "b", 5), (3, "a", 3), (4, "a", 1), (5, None, 7), (6, None, None)], "i int, g string, v int")
    assert [r[1] for r in rows(df.where("i < 5").select("i", W.rank("v")), "i")] == [2.5, 5, 4, 2.5, 1]
    assert [r[1] for r in rows(df.select("i", W.rank("v", keys=["g"])), "i")] == [2.5, 2, 1, 2.5, 1, 1, None]
    assert [r[1] for r in rows(df.select("i", W.cum_sum("v", order_by="i", keys=["g"])), "i")][5:] == [7.0, None]
    with pytest.raises(ValueError):
        W.rolling_mean("v", 0, order_by="i")


@pytest.fixture(scope="module")
def sides(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (None, "n")], "id int, name string")
    return a, spark.createDataFrame([(1, 0.1), (3, 0.3), (4, 0.4), (None, 9.0)], "id int, score double")


def test_joins(spark, sides):
    a, b = sides
    assert rows(R.join(a, b, on="id"), "id") == [(1, "x", 0.1), (3, "z", 0.3)]
    assert rows(R.join(a, b, on="id", how="left"), "name") == [(None, "n", None), (1, "x", 0.1), (2, "y", None), (3, "z", 0.3)]
    assert rows(R.join(a, b, on="id", how="right"), "score") == [(1, "x", 0.1), (3, "z", 0.3), (4, None, 0.4), (None, None, 9.0)]
    assert R.join(a, b, on="id", how="outer").count() == 6
    c = spark.createDataFrame([(1, "q"), (1, "r")], "key int, name string")
    assert rows(R.join(a, c, left_on="id", right_on="key"), "name_right") == [(1, "x", 1, "q"), (1, "x", 1, "r")]
    assert R.join(a, c, left_on="id", right_on="key", suffix="_c").columns == ["id", "name", "key", "name_c"]
    with pytest.raises(ValueError, match="how"):
        R.join(a, b, on="id", how="semi")
    with pytest.raises(TypeError, match="kinds"):
        R.join(a, c, left_on="name", right_on="key")
    with pytest.raises(ValueError, match="No column"):
        R.join(a, b, on="zz")


@pytest.mark.parametrize("how", ["left", "right", "outer"])
def test_null_keys_stay_out_of_the_shuffle(spark, how):
    """Most rows have no key: they come out unmatched, and no task gets them all."""
    side = lambda n, step, name: spark.range(n).select(F.when(F.col("id") % step == 0, F.col("id")).alias("k"), (F.col("id") % 10).alias("j"), F.col("id").alias(name))
    a, b = side(60_000, 100, "x"), side(90_000, 150, "y")
    tracker, stages = spark._jsparkSession.sharedState().statusStore(), spark._jsc.sc().statusStore()
    before = tracker.executionsCount()
    got = [tuple(r) for r in R.join(a, b.drop("j"), on="k", how=how).collect()]
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    runs = tracker.executionsList(int(before), int(tracker.executionsCount() - before))
    ids = [int(x) for i in range(runs.size()) for x in runs.apply(i).stages().mkString(",").split(",") if x]
    assert ids and max(stages.lastStageAttempt(k).shuffleReadRecords() for k in ids) < 5000
    left = {i: i if i % 100 == 0 else None for i in range(60_000)}
    right = {i: i if i % 150 == 0 else None for i in range(90_000)}
    want = [(k, i % 10, i, i if k is not None and right[i] is not None else None) for i, k in left.items() if how != "right" or (k is not None and right[i] is not None)]
    if how != "left":
        want += [(k, None, None, i) for i, k in right.items() if k is None or left.get(i) is None]
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    two = R.join(a.where("x < 300"), b.where("y < 300"), on=["k", "j"], how=how)
    assert two.columns == ["k", "j", "x", "y"] and two.where("x is not null and y is not null").count() == 1
    assert two.count() == {"left": 300, "right": 300, "outer": 599}[how] and two.where("j is null").count() == 0


def test_order_and_limits(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([5, None, 3, 5, 1])], "i int, v int")
    assert [r[0] for r in rows(R.sort(df, "v", tie=["i"]))] == [4, 2, 0, 3, 1]
    assert [r[0] for r in rows(R.sort(df, ["v", "i"], [True, False]))] == [0, 3, 2, 4, 1]
    assert [r[0] for r in rows(R.head(df, 2, order_by=["i"]))] == [0, 1] and [r[0] for r in rows(R.tail(df, 2, order_by=["i"]))] == [3, 4]
    for a, b in ((1, 3), (-2, None), (0, -1), (3, 99), (4, 2)):
        assert [r[0] for r in rows(R.slice_rows(df, a, b, order_by=["i"]))] == list(range(5))[a:b]
    assert [r[0] for r in rows(R.top_k(df, 2, "v", tie=["i"]))] == [0, 3]
    assert sorted(r[0] for r in rows(R.unique(df, ["v"], order_by=["i"]))) == [0, 1, 2, 4]
    assert {(r.i, r.n) for r in R.numbered(df.repartition(3), ["i"], "n").collect()} == {(i, i) for i in range(5)}
    many = spark.range(5000).select(F.xxhash64("id").alias("h"), "id")
    assert R.numbered(many.repartition(7), ["h"], "n").agg(F.count_distinct("n").alias("n"), F.min("n").alias("a"), F.max("n").alias("b")).first() == (5000, 0, 4999)
    with pytest.raises(ValueError):
        R.unique(df, ["v"])


def test_projection(spark):
    df = spark.createDataFrame([(1, 2.0, None), (3, float("nan"), "x")], "a int, b double, c string")
    assert R.rename(df, {"a": "z", "q": "r"}).columns == ["z", "b", "c"] and R.rename(df, {"a": "b"}).columns == ["b", "c"]
    assert R.drop_nulls(df).count() == 1 and R.drop_nulls(df, ["b"]).count() == 2
    assert rows(R.with_columns(df, a=F.col("b") * 0 + 7, d=F.col("a")).select("a", "d"), "d")[0] == (7.0, 1)
    assert R.with_aggregates(df, m=F.max("a")).select("m").distinct().collect()[0].m == 3
    assert R.where_rows(df, lambda r: r["a"] == 3).count() == 1 and R.select_aggregates(df, F.max("a").alias("m")).first().m == 3
    with pytest.raises(TypeError):
        R.where(df, F.col("a"))
    with pytest.raises(TypeError):
        R.with_columns(df, x=lambda r: 1)
    with pytest.raises(ValueError, match="No column"):
        R.drop_nulls(df, ["zz"])


def test_sample(spark):
    df = spark.range(50)
    a, b = ([r.id for r in R.sample(df.repartition(n), 10, seed=7, order_by=["id"]).collect()] for n in (2, 5))
    assert a == b and len(set(a)) == 10 and a != sorted(a)
    assert R.sample(df, 80, seed=1, order_by=["id"], with_replacement=True).count() == 80
    assert R.sample_approximate(df, 5, 1).count() == 5
    with pytest.raises(ValueError):
        R.sample(df, 51, seed=1, order_by=["id"])


def test_generator():
    g = Mulberry(42)
    # fixed values: the public generator's first numbers for this seed
    assert [round(g(), 10) for _ in range(3)] == [0.6011037519, 0.4482905590, 0.8524657935]
    assert sorted(Mulberry(1).places(20, 20)) == list(range(20))
    with pytest.raises(TypeError):
        Mulberry(1.5)


def test_reshaping(spark):
    a, b = spark.createDataFrame([(1, "p")], "x int, y string"), spark.createDataFrame([(2, True)], "x int, z boolean")
    assert rows(R.concat(a, b), "x") == [(1, "p", None), (2, None, True)]
    assert R.concat(a, spark.createDataFrame([(1.5,)], "x double")).dtypes[0] == ("x", "double")
    assert R.concat(a, spark.createDataFrame([(True,)], "x boolean")).dtypes[0] == ("x", "string")
    long = spark.createDataFrame([(0, 2023, "B", 1), (1, 2023, "A", 2), (2, 2024, "A", 3), (3, 2025, None, 4), (4, 2024, "A", 5)], "o int, year int, city string, v int")
    p = R.pivot(long, "year", "city", "v", order_by="o")
    assert p.columns == ["year", "B", "A"] and rows(p, "year") == [(2023, 1, 2), (2024, None, 3), (2025, None, None)]
    assert rows(R.pivot(long, "year", "city", "v", "mean", order_by="o"), "year")[1] == (2024, None, 4.0)
    assert rows(R.pivot(long, "year", "city", "v", "count", labels=["A", "B"]), "year") == [(2023, 1, 1), (2024, 2, None), (2025, None, None)]
    with pytest.raises(ValueError, match="agg"):
        R.pivot(long, "year", "city", "v", "mode", order_by="o")
    wide = spark.createDataFrame([(1, 10, None)], "id int, a int, b int")
    assert rows(R.melt(wide, ["id"]), "variable") == [(1, "a", 10), (1, "b", None)]
    assert R.melt(wide.withColumn("b", F.lit("t")), ["id"]).dtypes[2] == ("value", "string")


def test_durations():
    assert T.parse_duration("15m").amount == 900_000 and T.parse_duration("1q") == T.Duration(3, True) and T.parse_duration(5).amount == 5
    assert T.parse_duration("1.5h").amount == 5_400_000
    for bad in ("1.5mo", "x", "3 parsecs"):
        with pytest.raises(ValueError):
            T.parse_duration(bad)


def starts_by_hand(t, every, period, off, closed):
    inside = {"left": lambda a, b: a <= t < b, "right": lambda a, b: a < t <= b, "both": lambda a, b: a <= t <= b, "none": lambda a, b: a < t < b}[closed]
    return [k * every + off for k in range(-200, 200) if inside(k * every + off, k * every + off + period)]


@pytest.mark.parametrize("closed", ["left", "right", "both", "none"])
@pytest.mark.parametrize(("every", "period", "off"), [(10, 10, 0), (3, 6, 0), (5, 5, 2), (7, 3, -4), (4, 9, 13)])
def test_numeric_windows(spark, closed, every, period, off):
    df = spark.createDataFrame([(t,) for t in range(-25, 26)], "t int")
    got = {r.t: r.s for r in df.select("t", T.window_starts(F.col("t"), every, period, off, closed, numeric=True).alias("s")).collect()}
    assert got == {t: [float(x) for x in starts_by_hand(t, every, period, off, closed)] for t in range(-25, 26)}


def test_fractional_windows(spark):
    df = spark.createDataFrame([(-0.3,), (0.25,), (0.5,)], "t double")
    assert [r.t for r in T.assign_windows(df, "t", 0.5).orderBy("t").collect()] == [-0.5, 0.0, 0.5]


def test_calendar_windows(spark):
    days = [datetime(1969, 12, 31, 23), datetime(2024, 1, 31), datetime(2024, 2, 1), datetime(2024, 2, 29, 5), None]
    df = spark.createDataFrame([(d, 1) for d in days], "d timestamp_ntz, v int")
    got = rows(T.group_by_dynamic(df, "d", "1mo", F.sum("v").alias("v")), "d")
    assert got == [(datetime(1969, 12, 1), 1), (datetime(2024, 1, 1), 1), (datetime(2024, 2, 1), 2)]
    both = rows(T.group_by_dynamic(df, "d", "1mo", F.sum("v").alias("v"), closed="both"), "d")
    assert (datetime(2024, 1, 1), 2) in both
    two = rows(T.group_by_dynamic(df, "d", "1mo", F.sum("v").alias("v"), period="2mo"), "d")
    assert (datetime(2024, 1, 1), 3) in two and (datetime(1969, 11, 1), 1) in two
    assert rows(T.group_by_dynamic(df, "d", "1y", F.sum("v").alias("v"), offset="3mo"), "d")[1][0] == datetime(2023, 4, 1)
    assert T.assign_windows(df, "d", "1d", period="6h").count() == 3


def test_window_errors(spark):
    df = spark.createDataFrame([("2024", 1.0)], "s string, n double")
    for args in (("s", "1mo"), ("n", "1mo")):
        with pytest.raises((TypeError, ValueError)):
            T.assign_windows(df, *args)
    for kw in ({"every": "1d", "period": "1mo"}, {"every": "1d", "closed": "up"}, {"every": 0}):
        with pytest.raises(ValueError):
            T.window_starts(F.col("n"), numeric=True, **kw)


CSV = 'name,age,joined,active,zip\nAnn,31,2024-01-05,true,02134\n"Bo, Jr",,2024-02-01,false,\n'


def test_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text(CSV)
    for df in (C.from_text(spark, CSV, dtypes={"zip": "str"}), C.read_csv(spark, str(tmp_path / "x.csv"), dtypes={"zip": "text"})):
        assert [t for _, t in df.dtypes] == ["string", "double", "timestamp_ntz", "boolean", "string"]
        assert rows(df, "name") == [("Ann", 31.0, datetime(2024, 1, 5), True, "02134"), ("Bo, Jr", None, datetime(2024, 2, 1), False, None)]
    mixed = C.from_text(spark, "v;w\n1;\nbanana;\n", delimiter=";")
    assert mixed.dtypes == [("v", "string"), ("w", "string")]
    text = C.to_text(C.from_text(spark, CSV, dtypes={"zip": "str"}).orderBy("name"))
    assert text == 'name,age,joined,active,zip\nAnn,31,2024-01-05T00:00:00.000Z,true,02134\n"Bo, Jr",,2024-02-01T00:00:00.000Z,false,'
    C.write_csv(C.from_text(spark, CSV, dtypes={"zip": "str"}).coalesce(1), str(tmp_path / "out"))
    assert rows(C.read_csv(spark, str(tmp_path / "out"), dtypes={"zip": "str"}), "name")[1][0] == "Bo, Jr"
    assert C.from_text(spark, "a,b\n1,2\n", dtypes={"a": "integer"}).dtypes == [("a", "int"), ("b", "double")]


def test_profiles(spark):
    df = spark.createDataFrame([(1, 2, "a", True), (2, 4, "a", False), (3, 6, "b", None), (None, 8, None, True)], "x int, y int, s string, t boolean")
    d = {r.statistic: r.x for r in P.describe(df).collect()}
    assert d["count"] == 3 and d["null_count"] == 1 and d["50%"] == 2 and d["std"] == 1
    assert P.corr(df, "x", "y").first().corr == pytest.approx(1) and P.corr_matrix(df).count() == 4
    with pytest.raises(TypeError):
        P.corr(df, "x", "s")
    assert rows(P.value_counts(df, "s")) == [("a", 2), ("b", 1), (None, 0)]
    s = {r.column: r for r in P.summary_table(df).collect()}
    assert s["y"].median == 6 and s["s"].top == "a: 2, b: 1" and s["t"].share_true == pytest.approx(2 / 3) and s["x"].missing == 0.25
    assert sum(r["count"] for r in P.histogram(df, "y", 3).collect()) == 4 and P.histogram(df.limit(0), "y").count() == 0
    assert P.outliers(spark.createDataFrame([("g", float(v)) for v in (1, 2, 3, 4, 100)], "k string, v double"), "v", ["k"]).collect()[0].value == 100
    assert P.two_groups(df.select("x"), df.select("x")).groupBy("group").count().count() == 2
    f = spark.createDataFrame([(0, "a", 10.0, 1.0, 3.0), (1, "b", 5.0, -1.0, 2.0)], "o int, l string, e double, lo double, hi double")
    assert [r.excludes_zero for r in P.forest_rows(f, "l", "e", "lo", "hi").collect()] == [True, False]
    assert rows(P.funnel(f, "l", "e", "o"), "stage") == [("a", 10.0, None, 1.0, 1.0), ("b", 5.0, 0.5, 0.5, 0.5)]
    assert [r.previous_end for r in P.waterfall(f, "l", "lo", "hi", "o").orderBy("label").collect()] == [None, 3.0]
    tree = P.rollup_tree(spark.createDataFrame([("a", "x", 1.0), ("a", None, 2.0), (None, "y", 4.0)], "p string, q string, v double"), ["p", "q"], v=F.sum("v"))
    assert sorted((r.depth, str(r.p), str(r.q), r.v) for r in tree.collect()) == [(0, "None", "None", 7.0), (1, "a", "None", 3.0), (2, "a", "x", 1.0)]
    flows = P.flow_tree(spark.createDataFrame([("a", 1, 2), ("b", 3, None)], "p string, u int, w int"), ["p"], ["u", "w"])
    assert [(r.u, r.w, r.total) for r in flows.orderBy("depth", "p").collect()] == [(4.0, 2.0, 6.0), (1.0, 2.0, 3.0), (3.0, 0.0, 3.0)]
    assert P.rollup_tree(df, ["s"], r=P.rate(F.col("x"), F.col("y") * 0)).where("depth = 0").first().r == 0
    m = P.markers(df, "y").first()
    assert m.mean == 5 and m.median == 5
    c = spark.createDataFrame([("A", 0.1, 0.02)], "c string, b double, d double")
    assert P.power_rows(c, "c", "b", "d").first().n_per_arm > 1000


def test_exact_quantiles(spark):
    from granary.operators.quantiles import exact_quantiles

    df = spark.range(4000).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 7 != 0, F.rand(3)).alias("v")).unionByName(spark.createDataFrame([(None, 1.5), (9, None), (8, 2.0), (8, 4.0)], "k long, v double")).cache()
    ps = [0, 0.1, 0.5, 0.99, 1]
    got = {r.k: (r.n, r.q) for r in exact_quantiles(df.repartition(5), "v", ps, ["k"]).collect()}
    want = {r.k: (r.n, r.q) for r in df.where("v is not null").groupBy("k").agg(F.count("v").alias("n"), F.percentile("v", F.array(*map(F.lit, ps))).alias("q")).collect()}
    assert set(got) == set(want) and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)
    assert got[8][1] == pytest.approx([2, 2.2, 3, 3.98, 4])
    assert exact_quantiles(df, "v", [0.5]).first().n == sum(n for n, _ in got.values())
    with pytest.raises(ValueError):
        exact_quantiles(df, "v", [2])


def test_exact_quantiles_of_copies(spark):
    """Copies of a value, which lie in one range, reach a task as one row; ranks between copies and infinities are exact."""
    from granary.operators.quantiles import exact_quantiles

    tracker = spark._jsparkSession.sharedState().statusStore()
    df = spark.range(300_000).select(F.element_at(F.array(*map(F.lit, (1.0, 2.0, 2.0, 7.0))), (F.col("id") % 4 + 1).cast("int")).alias("v"))
    before = tracker.executionsCount()
    assert exact_quantiles(df, "v", [0, 0.25, 0.5, 0.75, 1]).first().q == [1, 1.75, 2, 3.25, 7]
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = spark._jsc.sc().statusStore()
    runs = tracker.executionsList(int(before), int(tracker.executionsCount() - before))
    ids = [k for i in range(runs.size()) for k in (int(x) for x in runs.apply(i).stages().mkString(",").split(",") if x)]
    read = [stages.lastStageAttempt(k).shuffleReadRecords() for k in ids]
    assert ids and max(read) < 1000, read
    ends = spark.createDataFrame([(float("-inf"),), (3.0,), (3.0,), (float("inf"),)], "v double")
    assert exact_quantiles(ends, "v", [0, 0.5, 1]).first().q == [float("-inf"), 3, float("inf")]
    assert exact_quantiles(ends.where("v > 3 and v < 4"), "v", [0.5]).first() is None


def test_formats_and_timeline(spark):
    from granary.functions.format import percent, short_number

    df = spark.createDataFrame([(12.0,), (1234.0,), (2.5e6,), (3e9,), (None,)], "v double")
    assert [r.x for r in df.select(short_number(F.col("v")).alias("x")).collect()] == ["12", "1.2K", "2.5M", "3.0B", None]
    assert df.select(percent(F.lit(0.125)).alias("x")).first().x == "12.5%"
    t = spark.createDataFrame([("b", "2024-01-31"), ("a", "2024-01-01"), ("c", "x")], "l string, d string")
    assert [(r.label, r.days_since_previous) for r in P.timeline(t, "d", "l").collect()][:2] == [("a", None), ("b", 30)]


def test_csv_address(spark, tmp_path):
    (tmp_path / "u.csv").write_text("a\n1\n")
    assert C.read_csv_url(spark, f"file://{tmp_path}/u.csv").first().a == 1.0


def test_take_valid_and_groups(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else float("nan") if i % 4 == 1 else float(i), "ab"[i % 2] if i else None) for i in range(10)], "k int, x double, g string")
    assert sorted(r.k for r in frames.take(df, [3, 0, 3, 99], order_by=["k"]).collect()) == [0, 3, 3]
    assert [r.valid for r in frames.is_valid(df, "x").orderBy("k").collect()] == [i % 4 > 1 for i in range(10)]
    assert [r.valid for r in frames.is_valid(df, "g").orderBy("k").collect()] == [False] + [True] * 9
    got = [(key["g"], sorted(r.k for r in rows.collect())) for key, rows in A.groups(df, ["g"])]
    assert got == [("a", [2, 4, 6, 8]), ("b", [1, 3, 5, 7, 9]), (None, [0])]
