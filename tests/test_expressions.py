"""Null, NaN, division, rounding, cast and string rules."""

from __future__ import annotations

import math
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from granary.functions import aggs as A
from granary.functions import exprs as E
from granary.operators import relational as R
from granary.sources import frames


def values(spark, schema, rows, build):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r.x for r in df.select("i", build.alias("x")).orderBy("i").collect()]


def same(a, b):
    return len(a) == len(b) and all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isnan(x) and math.isnan(y)) for x, y in zip(a, b, strict=True))


INF, NAN = math.inf, math.nan


def test_division_and_remainder(spark):
    rows = [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 0.0), (1.0, None), (7.0, 2.0), (NAN, 0.0), (-7.0, 3.0)]
    assert same(values(spark, "a double, b double", rows, E.div(F.col("a"), F.col("b"))), [INF, -INF, NAN, None, None, 3.5, NAN, -7 / 3])
    assert same(values(spark, "a double, b double", rows, E.mod(F.col("a"), F.col("b"))), [NAN, NAN, NAN, None, None, 1.0, NAN, -1.0])


def test_math(spark):
    one = lambda build, xs: values(spark, "a double", [(x,) for x in xs], build(F.col("a")))
    assert same(one(E.log, [1.0, 0.0, -1.0, None]), [0.0, -INF, NAN, None])
    assert same(one(E.sqrt, [4.0, -1.0, None]), [2.0, NAN, None])
    assert same(one(E.round_half_up, [2.5, -2.5, 0.5, -0.5, 1e300, NAN, INF, None]), [3.0, -2.0, 1.0, 0.0, 1e300, NAN, INF, None])
    assert one(lambda c: E.round_half_up(c, 2), [1.005, 2.675, 1234.567]) == [1.0, 2.68, 1234.57]
    assert one(lambda c: E.power(c, 2), [3.0]) == [9.0] and one(E.neg, [1.0]) == [-1.0] and one(E.absolute, [-2.0]) == [2.0]
    assert one(E.exp, [0.0]) == [1.0] and one(lambda c: E.sub(E.mul(E.add(c, 1), 2), 3), [1.0, None]) == [1.0, None]


def test_log_is_right_to_the_last_place(spark):
    from decimal import Decimal

    xs = [i / 100 for i in range(1, 400)] + [3.7**k for k in range(-500, 500, 7)] + [math.nextafter(1, 0), math.nextafter(1, 2), 1.7976931348623157e308]
    got = values(spark, "a double", [(x,) for x in xs], E.log(F.col("a")))
    assert got[8] == -2.4079456086518722  # Spark's ln ends in 0
    wrong = [x for x, y in zip(xs, got, strict=True) if abs(Decimal(y) - Decimal(x).ln()) > Decimal(0.52) * Decimal(math.ulp(y))]
    assert wrong == []
    assert same(values(spark, "a double", [(INF,), (-INF,), (NAN,), (5e-324,)], E.log(F.col("a"))), [INF, NAN, NAN, math.log(5e-324)])


def test_scalar_math_equals_its_sql_bit_by_bit(spark, tmp_path):
    """Also where values are null, negative or NaN."""
    import struct

    from granary.plans.catalogue import QUERIES, SQL

    from .sqlcompare import connect

    con = connect()
    con.execute("CREATE TABLE more AS SELECT * FROM lineitem")
    for i, (price, quantity, discount, tax) in enumerate([(None, 25, None, None), (30000, None, -0.1, 0), ("NaN", 25, "NaN", 0.02), (None, 7, 0.09, 0.06), (29000, 25, 0, 0.08)]):
        con.execute("INSERT INTO more (l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_discount, l_tax) VALUES (?, 1, ?, ?, ?, ?)", [-i - 1, price, quantity, discount, tax])
    con.execute(f"COPY more TO '{tmp_path}/lineitem.parquet'")
    found = con.execute(SQL["scalar_math"].replace("FROM lineitem", "FROM more"))
    names = [d[0] for d in found.description]
    bits = lambda rows: sorted(tuple("null" if x is None else struct.pack(">d", x).hex() if isinstance(x, float) and x == x else str(x) for x in r) for r in rows)
    assert bits(QUERIES["scalar_math"](spark, str(tmp_path)).select(*names).collect()) == bits(found.fetchall())


def test_strict_logic(spark):
    three = [True, False, None]
    rows = [(a, b) for a in three for b in three]
    strict = lambda f: [None if a is None or b is None else f(a, b) for a, b in rows]
    assert values(spark, "a boolean, b boolean", rows, E.both(F.col("a"), F.col("b"))) == strict(lambda a, b: a and b)
    assert values(spark, "a boolean, b boolean", rows, E.either(F.col("a"), F.col("b"))) == strict(lambda a, b: a or b)
    assert values(spark, "a boolean", [(x,) for x in three], E.negate(F.col("a"))) == [False, True, None]


def test_membership_and_ranges(spark):
    xs = [(1,), (5,), (None,)]
    c = F.col("a")
    assert values(spark, "a int", xs, E.is_in(c, [1, 2])) == [True, False, False]
    assert values(spark, "a int", xs, E.is_in(c, [])) == [False] * 3
    assert values(spark, "a int", xs, E.negate(E.is_in(c, [1]))) == [False, True, True]
    assert values(spark, "a int", xs, E.between(c, 1, 4)) == [True, False, None]
    assert values(spark, "a int", xs, E.fill_null(c, 0)) == [1, 5, 0]
    assert values(spark, "a int", xs, E.when(E.gt(c, 2), "x", "y")) == ["y", "x", "y"]
    assert values(spark, "a int", xs, E.is_null(c)) == [False, False, True]
    for op, want in ((E.gte, [True, True, None]), (E.lt, [False, False, None]), (E.lte, [True, False, None]), (E.eq, [True, False, None]), (E.neq, [False, True, None])):
        assert values(spark, "a int", xs, op(c, 1)) == want
    with pytest.raises(TypeError):
        E.between(c, "a", "b")


def test_casts(spark):
    texts = [("3.7",), ("",), ("oops",), ("1e3",), ("true",), (None,)]
    c = F.col("a")
    assert values(spark, "a string", texts, E.cast(c, "float")) == [3.7, None, None, 1000.0, None, None]
    assert values(spark, "a string", texts, E.cast(c, "integer")) == [3, None, None, 1000, None, None]
    assert values(spark, "a string", texts, E.cast(c, "bool"))[4] is True
    assert values(spark, "a double", [(3e9,), (-2.9,)], E.cast(c, "i32")) == [None, -2]
    assert values(spark, "a string", [("2024-02-29",)], E.cast(c, "date")) == [datetime(2024, 2, 29)]
    with pytest.raises(ValueError, match="Unknown type"):
        E.cast(c, "blob")


def test_strings(spark):
    c = F.col("a")
    texts = [("\t  a.B \n",), ("",), ("x𝔘y",), (None,), ("a.b.c",)]
    assert values(spark, "a string", texts, E.str_strip(c)) == ["a.B", "", "x𝔘y", None, "a.b.c"]
    assert values(spark, "a string", texts, E.str_len(c))[2:] == [4.0, None, 5.0]
    assert values(spark, "a string", texts, E.str_contains(c, ".")) == [True, False, False, False, True]
    assert values(spark, "a string", texts, E.str_contains(c, re.compile("^A", re.I)))[4] is True
    assert values(spark, "a string", texts, E.str_replace(c, ".", "-"))[4] == "a-b-c"
    assert values(spark, "a string", texts, E.str_replace(c, re.compile("[ac]"), "_"))[4] == "_.b._"
    assert values(spark, "a string", texts, E.str_starts_with(c, "a")) == [False, False, False, False, True]
    assert values(spark, "a string", texts, E.str_ends_with(c, "c"))[3:] == [False, True]
    s = "hello"
    for a, b in ((0, 2), (1, None), (-3, None), (-3, -1), (2, 1), (0, 99), (9, None), (-9, 2)):
        assert values(spark, "a string", [(s,)], E.str_slice(c, a, b)) == [s[a:b]], (a, b)


def test_dates(spark):
    when = [(datetime(2024, 1, 7, 13, 5),), (None,)]
    got = [values(spark, "a timestamp_ntz", when, f(F.col("a"))) for f in (E.dt_year, E.dt_month, E.dt_day, E.dt_hour, E.dt_weekday)]
    assert got == [[2024.0, None], [1.0, None], [7.0, None], [13.0, None], [0.0, None]]
    assert values(spark, "a timestamp_ntz", [(datetime(1970, 1, 1, 0, 0, 1),)], E.epoch_millis(F.col("a"))) == [1000.0]


def test_map_values_sees_nulls(spark):
    got = values(spark, "a int", [(1,), (None,)], E.map_values(F.col("a"), lambda v: -1.0 if v is None else v * 2.0))
    assert got == [2.0, -1.0]


def test_aggregates(spark):
    df = spark.createDataFrame([("a", 1, 3, "x"), ("a", 2, None, "y"), ("a", 3, 5, None), ("b", 4, None, None), (None, 5, 6, "z")], "k string, o int, v int, s string")
    out = A.group(df, ["k"], A.total("v").alias("s"), A.mean("v").alias("m"), A.count("v").alias("n"), A.first_by("v", "o").alias("f"), A.last_by("s", "o").alias("l"), A.implode("v", "o").alias("im"), A.std("v").alias("sd"), A.n_unique("v").alias("u"), A.quantile("v", 0.25).alias("q"))
    got = {r.k: r.asDict() for r in out.collect()}
    assert got["a"] == {"k": "a", "s": 8.0, "m": 4.0, "n": 2, "f": 3, "l": "y", "im": [3, 5], "sd": pytest.approx(math.sqrt(2)), "u": 2, "q": 3.5}
    assert got["b"] == {"k": "b", "s": 0.0, "m": None, "n": 0, "f": None, "l": None, "im": [], "sd": None, "u": 0, "q": None}
    assert got[None]["sd"] is None and got[None]["s"] == 6.0
    with pytest.raises(ValueError, match="key"):
        A.group(df, [], A.total("v"))
    with pytest.raises(ValueError, match="Duplicate"):
        A.group(df, ["k"], A.total("v").alias("k"))
    flat = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (None, 5.0)], "a double, b double")
    assert flat.agg(A.correlation("a", "b").alias("c")).first().c is None
    sums = A.per_group(df, ["k"], lambda key, pdf: pdf[["o"]].sum().to_frame().T, "o long").collect()
    assert sorted(r.o for r in sums) == [4, 5, 6]


def test_frames(spark):
    df = frames.from_rows(spark, [{"a": 1, "b": "x"}, {"a": 2.5}, {"a": float("nan"), "b": 3}])
    assert df.dtypes == [("a", "double"), ("b", "string")]
    assert frames.to_rows(df) == [{"a": 1.0, "b": "x"}, {"a": 2.5, "b": None}, {"a": None, "b": "3"}]
    assert frames.from_columns(spark, {"n": [1, None], "t": [True, None], "z": [None, None]}).dtypes == [("n", "int"), ("t", "boolean"), ("z", "double")]
    with pytest.raises(ValueError, match="rectangular"):
        frames.from_columns(spark, {"a": [1], "b": []})
    assert frames.shape(df) == (3, 2) and frames.row(df, 1, order_by=[F.col("a").asc_nulls_last()]) == {"a": 2.5, "b": None}
    assert frames.values(df, "b", order_by=["a"], valid_only=True) and len(list(frames.iterate(df))) == 3
    assert {r.column: r.nulls for r in frames.null_counts(df).collect()} == {"a": 1, "b": 1}
    assert frames.to_columns(frames.column(spark, [1, 2], name="v")) == {"v": [1, 2]}
    with pytest.raises(ValueError, match="No column"):
        frames.get_column(df, "zz")
    assert R.select(df, F.lit(1).alias("a"), F.lit(2).alias("a")).collect()[0].asDict() == {"a": 2}
