"""Profiles of frames and the figures behind charts, as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

from ..functions.aggs import correlation
from ..stats.power import power_analysis
from .quantiles import exact_quantiles


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]


def value_counts(df: DataFrame, name: str) -> DataFrame:
    """Non-null values by count, largest first; the null group shows a count of 0. Ties by value."""
    return df.groupBy(name).agg(F.count(name).alias("count")).orderBy(F.desc("count"), F.col(name).asc_nulls_last())


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(statistic, one column for each numeric one): count, null_count, mean, std, min, 25%, 50%, 75%, max.

    Exact interpolated quantiles of columns of any size, by sorting; the rest is one aggregation. NaN do
    not count in quantiles.
    """
    names = list(columns) if columns else numeric_columns(df)
    cells = [F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("double").alias("v")) for i, c in enumerate(names)]
    found = exact_quantiles(df.select(F.explode(F.array(*cells)).alias("x")).select("x.*"), "v", (0.25, 0.5, 0.75), ["i"]) if names else None
    quartiles = {names[r["i"]]: r["q"] for r in found.collect()} if names else {}  # a row for each column
    labels = ("count", "null_count", "mean", "std", "min", "25%", "50%", "75%", "max")

    def stats(c: str) -> Column:
        x = F.col(f"`{c}`").cast("double")
        q = [F.lit(v).cast("double") for v in quartiles.get(c, (None, None, None))]
        return F.array(F.count(x).cast("double"), F.count_if(x.isNull()).cast("double"), F.avg(x), F.stddev_samp(x), F.min(x), q[0], q[1], q[2], F.max(x)).alias(c)

    one = df.agg(*(stats(c) for c in names))
    rows = F.arrays_zip(F.array(*map(F.lit, labels)).alias("statistic"), *(F.col(f"`{c}`") for c in names))
    return one.select(F.inline(rows)).toDF("statistic", *names)


def corr(df: DataFrame, a: str, b: str) -> DataFrame:
    """(corr): Pearson's over rows where both are present."""
    for c in (a, b):
        if not isinstance(df.schema[c].dataType, (NumericType, BooleanType)):
            raise TypeError(f"{c} is not numeric")
    return df.agg(correlation(a, b).alias("corr"))


def corr_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(a, b, corr) of all pairs of numeric columns, 1 on the diagonal; one aggregation."""
    names = list(columns) if columns else numeric_columns(df)
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    one = df.agg(*(correlation(f"`{names[i]}`", f"`{names[j]}`").alias(f"{i}_{j}") for i, j in pairs)) if pairs else df.sparkSession.range(1)
    cell = lambda i, j: F.lit(1.0) if i == j else F.col(f"`{min(i, j)}_{max(i, j)}`")
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), cell(i, j).alias("corr")) for i, a in enumerate(names) for j, b in enumerate(names)]
    return one.select(F.inline(F.array(*rows)))


def summary_table(df: DataFrame, top: int = 5) -> DataFrame:
    """(column, dtype, missing, mean, median, sd, n_distinct, top, share_true) of every column.

    The median is the upper one of an even count; top lists the most frequent strings with their counts.
    """
    n = F.count(F.lit(1)).cast("double")
    empty = {"mean": "double", "median": "double", "sd": "double", "n_distinct": "bigint", "share_true": "double"}

    def row(f) -> Column:
        c, got = F.col(f"`{f.name}`"), {}
        if isinstance(f.dataType, NumericType):
            x = c.cast("double")
            got = {"mean": F.avg(x), "sd": F.stddev_samp(x), "median": F.expr(f"-(percentile_disc(0.5) WITHIN GROUP (ORDER BY -CAST(`{f.name}` AS DOUBLE)))")}
        elif isinstance(f.dataType, StringType):
            got = {"n_distinct": F.count_distinct(c)}
        elif isinstance(f.dataType, BooleanType):
            got = {"share_true": F.avg(c.cast("double"))}
        cells = [got.get(k, F.lit(None)).cast(t).alias(k) for k, t in empty.items()]
        return F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"), F.try_divide(F.count_if(c.isNull()).cast("double"), n).alias("missing"), *cells)

    out = df.agg(F.array(*(row(f) for f in df.schema)).alias("x")).select(F.inline("x"))
    texts = [f.name for f in df.schema if isinstance(f.dataType, StringType)]
    if not texts:
        return out.withColumn("top", F.lit(None).cast("string"))
    best = top_values(df, texts, top).groupBy("column").agg(F.sort_array(F.collect_list(F.struct("rank", F.concat("value", F.lit(": "), F.col("count").cast("string")).alias("t")))).alias("x"))
    return out.join(best.select("column", F.array_join(F.transform("x", lambda v: v["t"]), ", ").alias("top")), "column", "left")


def top_values(df: DataFrame, columns: Sequence[str], k: int = 5) -> DataFrame:
    """(column, value, count, rank) of the k most frequent values of each; ties by value.

    A top-k of each column's counts, so no task sorts all values of a column.
    """
    parts = []
    for c in columns:
        counts = df.select(F.col(f"`{c}`").cast("string").alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("count"))
        best = counts.orderBy(F.desc("count"), "value").limit(k)
        parts.append(best.select(F.lit(c).alias("column"), "value", "count", F.row_number().over(Window.orderBy(F.desc("count"), "value")).alias("rank")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, low, high, count): equal widths from the least to the largest value, the last bin closed."""
    x = F.col(column).cast("double")
    rows = df.where(x.isNotNull() & ~F.isnan(x)).select(x.alias("x"))
    r = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    if r["lo"] is None:
        return rows.select(F.lit(0).alias("bin"), F.col("x").alias("low"), F.col("x").alias("high"), F.lit(0).cast("long").alias("count")).limit(0)
    width = (r["hi"] - r["lo"]) / bins or 1.0
    at = F.least(F.floor((F.col("x") - r["lo"]) / width), F.lit(bins - 1)).cast("int")
    counts = rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(counts, "bin", "left").select("bin", (r["lo"] + F.col("bin") * width).alias("low"), (r["lo"] + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).cast("long").alias("count"))


def markers(df: DataFrame, column: str, percentiles: Sequence[float] = (0.05, 0.95)) -> DataFrame:
    """(mean, median, percentiles) in one row."""
    q = (exact_quantiles(df, column, (0.5, *percentiles)).first() or {"q": [None] * (1 + len(percentiles))})["q"]
    return df.agg(F.avg(F.col(column).cast("double")).alias("mean")).select("mean", F.lit(q[0]).cast("double").alias("median"), F.array(*(F.lit(v).cast("double") for v in q[1:])).alias("percentiles"))


def box_stats(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """(…by, n, q1, median, q3, low_whisker, high_whisker): whiskers end at the last value within 1.5 IQR."""
    x = F.col(column).cast("double")
    rows = df.where(x.isNotNull()).select(*by, x.alias("x_"))
    q = exact_quantiles(rows, "x_", (0.25, 0.5, 0.75), by).select(*by, "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    fenced = _fenced(rows, q, by)
    ends = fenced.where("inside").groupBy(*by).agg(F.min("x_").alias("low_whisker"), F.max("x_").alias("high_whisker"))
    return q.join(ends, list(by), "left")


def _fenced(rows: DataFrame, q: DataFrame, by: Sequence[str]) -> DataFrame:
    step = 1.5 * (F.col("q3") - F.col("q1"))
    return rows.join(q.drop("n"), list(by)).withColumn("inside", F.col("x_").between(F.col("q1") - step, F.col("q3") + step))


def outliers(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """(…by, value) of the rows beyond the fences."""
    x = F.col(column).cast("double")
    rows = df.where(x.isNotNull()).select(*by, x.alias("x_"))
    return _fenced(rows, box_stats(df, column, by).select(*by, "n", "q1", "q3"), by).where("not inside").select(*by, F.col("x_").alias("value"))


def two_groups(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("A", "B"), label: str = "group") -> DataFrame:
    """Both frames in one, tagged."""
    return a.withColumn(label, F.lit(names[0])).unionByName(b.withColumn(label, F.lit(names[1])), allowMissingColumns=True)


def forest_rows(df: DataFrame, label: str, estimate: str, low: str, high: str) -> DataFrame:
    """(label, estimate, low, high, excludes_zero) from the largest estimate down."""
    return df.select(F.col(label).alias("label"), *(F.col(c).cast("double").alias(n) for c, n in ((estimate, "estimate"), (low, "low"), (high, "high")))).withColumn("excludes_zero", (F.col("low") > 0) | (F.col("high") < 0)).orderBy(F.desc("estimate"), "label")


def funnel(df: DataFrame, stage: str, value: str, order_by: str) -> DataFrame:
    """(stage, value, of_previous, of_first, of_largest) of a table of stages, in order."""
    w = Window.orderBy(order_by)  # a row for each stage
    v = F.col(value).cast("double")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.select(F.col(stage).alias("stage"), v.alias("value"), F.try_divide(v, F.lag(v).over(w)).alias("of_previous"), F.try_divide(v, F.first_value(v).over(whole)).alias("of_first"), F.try_divide(v, F.max(v).over(whole)).alias("of_largest"))


def bump_ranks(df: DataFrame, period: str, value: str, series: str, top_n: int | None = None) -> DataFrame:
    """``df`` with rank: by value down within a period, ties by name; top_n keeps series that ever reach it."""
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(period).orderBy(F.col(value).desc_nulls_last(), series)))
    return out if top_n is None else out.join(out.where(F.col("rank") <= top_n).select(series).distinct(), series, "left_semi")


def every_nth(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """The rows at places 0, n, 2n, ... of the order."""
    from .relational import numbered

    return numbered(df, order_by, "place_").where(F.col("place_") % n == 0).drop("place_")


def dot_counts(df: DataFrame, category: str, interval: int = 1) -> DataFrame:
    """(category, count, dots): a dot stands for ``interval`` rows."""
    return df.groupBy(category).agg(F.count("*").alias("count")).withColumn("dots", F.floor(F.col("count") / interval))


def waterfall(df: DataFrame, label: str, start: str, end: str, order_by: str) -> DataFrame:
    """(label, start, end, previous_end, change): bars of a table of steps and what joins them."""
    return df.select(F.col(label).alias("label"), F.col(start).cast("double").alias("start"), F.col(end).cast("double").alias("end"), F.lag(F.col(end).cast("double")).over(Window.orderBy(order_by)).alias("previous_end"), (F.col(end) - F.col(start)).cast("double").alias("change"))


def did_means(df: DataFrame, outcome: str, treatment: str, post: str) -> DataFrame:
    """(treated_pre, treated_post, control_pre, control_post, counterfactual, att) in one row; an empty cell raises."""
    y, t, p = F.col(outcome).cast("double"), F.coalesce(F.col(treatment).cast("double"), F.lit(0.0)) != 0, F.coalesce(F.col(post).cast("double"), F.lit(0.0)) != 0
    cells = {"treated_pre": t & ~p, "treated_post": t & p, "control_pre": ~t & ~p, "control_post": ~t & p}
    one = df.agg(*(F.avg(F.when(c, y)).alias(n) for n, c in cells.items()))
    cell = lambda n: F.when(F.col(n).isNull(), F.raise_error(F.lit(f"No rows in the cell {n}")).cast("double")).otherwise(F.col(n))
    one = one.select(*(cell(n).alias(n) for n in cells))
    other = F.col("treated_pre") + F.col("control_post") - F.col("control_pre")
    return one.withColumns({"counterfactual": other, "att": F.col("treated_post") - other})


def rollup_tree(df: DataFrame, levels: Sequence[str], **metrics: Column) -> DataFrame:
    """(…levels, depth, metrics) of every node; a null level ends the descent, so its rows count above only."""
    clean, alive = df, F.lit(True)
    for c in levels:
        alive = alive & F.col(c).isNotNull()
        clean = clean.withColumn(f"l_{c}", F.when(alive, F.col(c)))
    named = [f"l_{c}" for c in levels]
    out = clean.rollup(*named).agg(F.grouping_id().alias("g_"), *(m.alias(n) for n, m in metrics.items()))
    depth = F.lit(0)
    for i in range(1, len(levels) + 1):
        depth = F.when(F.col("g_") == (1 << (len(levels) - i)) - 1, i).otherwise(depth)
    out = out.withColumn("depth", depth)
    filled = F.lit(True)
    for i, c in enumerate(named):
        filled = filled & ((F.col("depth") <= i) | F.col(c).isNotNull())
    return out.where(filled).select(*(F.col(f"l_{c}").alias(c) for c in levels), "depth", *metrics)


def rate(numerator: Column, denominator: Column) -> Column:
    """sum / sum of a node; 0 where the denominator is not positive."""
    d = F.sum(denominator)
    return F.when(d > 0, F.sum(numerator) / d).otherwise(F.lit(0.0))


def flow_tree(df: DataFrame, levels: Sequence[str], buckets: Sequence[str]) -> DataFrame:
    """Node totals of each bucket and their sum, at every depth."""
    sums = {b: F.coalesce(F.sum(F.col(b).cast("double")), F.lit(0.0)) for b in buckets}
    total = None
    for s in sums.values():
        total = s if total is None else total + s
    return rollup_tree(df, levels, **sums, total=total)


def timeline(df: DataFrame, date: str, label: str) -> DataFrame:
    """(label, date, days_since_previous) in order of the date; texts are read as dates, others fail to null."""
    rows = df.select(F.col(label).alias("label"), F.col(date).try_cast("timestamp").cast("timestamp_ntz").alias("date"))
    w = Window.orderBy(F.col("date").asc_nulls_last(), "label")  # a row for each event of a figure
    return rows.withColumn("days_since_previous", F.datediff("date", F.lag("date").over(w))).orderBy(F.col("date").asc_nulls_last(), "label")


def power_rows(df: DataFrame, cohort: str, base_rate: str, behavior_change: str, **options) -> DataFrame:
    """(cohort, n_per_arm, total_n, p2) of a small table of cohorts."""
    rows = [(r[cohort], *(lambda p: (p.n_per_arm, p.total_n, p.p2))(power_analysis(r[base_rate], r[behavior_change], **options))) for r in df.select(cohort, base_rate, behavior_change).collect()]
    return df.sparkSession.createDataFrame(rows, f"`{cohort}` {df.schema[cohort].dataType.simpleString()}, n_per_arm long, total_n long, p2 double")
