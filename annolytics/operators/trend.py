"""Densities and trends over time."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolytics.functions import stats
from annolytics.operators.relational import join_on
from annolytics.operators.windows import quantiles
from annolytics.session import materialize


def bandwidths(counts: DataFrame, x: str, n: str, by: Sequence[str] = ()) -> DataFrame:
    """Rule-of-thumb width ``h`` 0.9 * min(sd, IQR/1.34) * n^-0.2 (Silverman 1986) and ``total`` per group of counted values.

    As usual, sd alone is used when the IQR is 0, then |x|, then 1.
    """
    total = F.sum(n).cast("double")
    mean_x = F.sum(F.col(n) * F.col(x)) / total
    var = F.try_divide(F.sum(F.col(n) * F.col(x) * F.col(x)) - total * mean_x * mean_x, total - 1)
    sums = counts.groupBy(*by).agg(F.sqrt(F.greatest(var, F.lit(0.0))).alias("_sd"), F.min(x).alias("_least"), total.alias("total"))
    cuts = quantiles(counts, by, x, {"_q1": 0.25, "_q3": 0.75}, n)
    sums = join_on(sums, cuts, by) if by else sums.withColumns({c: cuts.select(c).scalar() for c in ("_q1", "_q3")})
    sd = F.col("_sd")
    low = F.least(sd, (F.col("_q3") - F.col("_q1")) / 1.34)
    spread = F.when(low > 0, low).when(sd > 0, sd).otherwise(F.coalesce(F.nullif(F.abs("_least"), F.lit(0.0)), F.lit(1.0)))
    return sums.select(*by, (0.9 * spread * F.pow("total", F.lit(-0.2))).alias("h"), "total")


def kernel_density(
    df: DataFrame, x: str, low: float, high: float, points: int, by: Sequence[str] = (), width_by: Sequence[str] | None = None
) -> DataFrame:
    """Gaussian kernel density on an even grid, per group.

    Rows are counted per distinct x first; each distinct value then spreads over the grid inside its task. With
    ``width_by`` the bandwidth is the mean of the widths of the groups that share those columns.
    """
    counts = df.where(F.col(x).isNotNull()).groupBy(*by, F.col(x).cast("double").alias("_x")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    counts = materialize(counts, "value-counts")
    widths = bandwidths(counts, "_x", "_n", by)
    if width_by is not None:
        shared = widths.groupBy(*width_by).agg(F.avg("h").alias("h"))
        widths = join_on(widths.drop("h"), shared, width_by) if width_by else widths.withColumn(
            "h", shared.select("h").scalar()
        )
    step = (high - low) / (points - 1)
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: low + i * F.lit(step))
    spread = counts.withColumn("grid", F.explode(grid))
    joined = join_on(spread, widths, by) if by else spread.withColumn(
        "h", widths.select("h").scalar()
    ).withColumn("total", widths.select("total").scalar())
    z = (F.col("grid") - F.col("_x")) / F.col("h")
    kernel = F.sum(F.col("_n") * F.exp(-0.5 * z * z)) / (F.first("total") * F.first("h") * math.sqrt(2 * math.pi))
    return joined.groupBy(*by, "grid").agg(kernel.alias("density"))


def linear_trend(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Least-squares line of y on x per group."""
    return df.groupBy(*by).agg(
        F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"),
    )


def binned_trend(df: DataFrame, by: Sequence[str], x: str, y: str, width: float) -> DataFrame:
    """Mean and standard error of y per bin of x."""
    index = F.floor(F.col(x) / width).cast("long").alias("bin")
    return df.where(F.col(x).isNotNull()).groupBy(*by, index).agg(
        F.count(y).alias("n"), F.avg(y).alias("mean"), stats.standard_error(F.col(y)).alias("se")
    )


def popularity(df: DataFrame, by: Sequence[str], weeks: str) -> DataFrame:
    """Mean, median and mean log10 of a count per group."""
    means = df.groupBy(*by).agg(
        F.count(weeks).alias("n"), F.avg(weeks).alias("mean"), F.avg(F.when(F.col(weeks) > 0, F.log10(weeks))).alias("mean_log10"),
    )
    return join_on(means, quantiles(df, by, weeks, {"median": 0.5}), by, "left")
