"""Gaussian kernel densities on a grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.quantiles import exact_quantiles

def bandwidths(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Silverman's rule: 0.9 min(sd, IQR / 1.34) n ** -0.2, with n, low and high; null under 2 values."""
    x = F.col(column).cast("double")
    rows = df.where(x.isNotNull() & ~F.isnan(x)).select(*by, x.alias("x_"))
    stats = rows.groupBy(*by).agg(F.count("x_").alias("n"), F.stddev_samp("x_").alias("sd"), F.min("x_").alias("low"), F.max("x_").alias("high")).alias("s")
    q = exact_quantiles(rows, "x_", (0.25, 0.75), by).alias("q")
    same = F.lit(True)
    for k in by:
        same = same & F.col(f"s.`{k}`").eqNullSafe(F.col(f"q.`{k}`"))
    # one row for each group on either side
    stats = stats.join(q, same, "left").select(*(F.col(f"s.`{k}`") for k in by), "s.n", "sd", "low", "high", "q.q")
    iqr = (F.col("q")[1] - F.col("q")[0]) / 1.34
    spread = F.when(iqr > 0, F.least("sd", iqr)).otherwise(F.col("sd"))
    h = F.when(F.col("n") >= 2, F.when(spread > 0, 0.9 * spread * F.pow(F.col("n").cast("double"), F.lit(-0.2))).otherwise(F.lit(1.0)))
    return stats.select(*by, "n", "low", "high", h.alias("bandwidth"))


def kde(df: DataFrame, column: str, *, by: Sequence[str] = (), bandwidth: float | None = None, cut: float = 3, n: int = 200, normalize: bool = False) -> DataFrame:
    """(…by, x, density) at n points from cut bandwidths under the least value to as many over the largest.

    Each value is put in one pass against its group's own grid of n points (an array, not a join);
    partial sums by grid point are all that is shuffled. ``normalize`` divides by the group's peak.
    """
    v = F.col(column).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(*by, v.alias("v_"))
    bands = bandwidths(df, column, by)
    if bandwidth is not None:
        bands = bands.withColumn("bandwidth", F.lit(float(bandwidth)))
    bands = bands.where("n >= 2").withColumns({"x0_": F.col("low") - cut * F.col("bandwidth"), "dx_": (F.col("high") - F.col("low") + 2 * cut * F.col("bandwidth")) / (n - 1)})
    rows = rows.groupBy(*by, "v_").agg(F.count("*").alias("m_"))  # equal values are put against the grid once
    joined = rows.join(bands, list(by)) if by else rows.join(F.broadcast(bands))
    points = joined.select(*by, "v_", "m_", "n", "bandwidth", "x0_", "dx_", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i_"))
    x = F.col("x0_") + F.col("i_") * F.col("dx_")
    z = (x - F.col("v_")) / F.col("bandwidth")
    out = points.groupBy(*by, "i_").agg(F.first(x).alias("x"), (F.sum(F.col("m_") * F.exp(-0.5 * z * z)) / F.first(F.col("n") * F.col("bandwidth") * 2.5066282746310002)).alias("density"))
    if normalize:
        peak = out.groupBy(*by).agg(F.max("density").alias("peak_"))
        out = (out.join(peak, list(by)) if by else out.join(F.broadcast(peak))).withColumn("density", F.col("density") / F.col("peak_"))
    return out.select(*by, "x", "density")
