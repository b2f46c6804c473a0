"""Densities, peaks and per-track summaries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, key: str, value: str, weight: str, low: float, step: float) -> DataFrame:
    """(key, bin, w): weights added by bin."""
    return df.groupBy(key, F.floor((F.col(value) - low) / step).alias("bin")).agg(F.sum(weight).alias("w"))


def density(df: DataFrame, key: str, value: str, weight: str, low: float, step: float, radius: int, sigma: float = 1.0) -> DataFrame:
    """The histogram under a Gaussian kernel over neighbouring bins; each bin is spread to its 2 radius + 1 neighbours, so nothing
    is joined."""
    h = histogram(df, key, value, weight, low, step)
    kernel = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(math.exp(-0.5 * (o / sigma) ** 2)).alias("k")) for o in range(-radius, radius + 1)])
    spread = h.select(key, "bin", "w", F.inline(kernel)).groupBy(key, (F.col("bin") + F.col("o")).alias("bin")).agg(F.sum(F.col("w") * F.col("k")).alias("density"), F.count_if(F.col("o") == 0).alias("own"))
    return spread.filter("own > 0").drop("own")


def peaks(df: DataFrame, key: str, x: str, height: str) -> DataFrame:
    """Rows at least as high as the one before and higher than the one after; ends count."""
    w = Window.partitionBy(key).orderBy(x)
    before, after = F.lag(height).over(w), F.lead(height).over(w)
    return df.withColumn("p", before).withColumn("q", after).filter((F.col("p").isNull() | (F.col(height) >= F.col("p"))) & (F.col("q").isNull() | (F.col(height) > F.col("q")))).drop("p", "q")


def strongest(h: DataFrame, key: str, k: int, least: float) -> DataFrame:
    """The k heaviest bins of each key with at least that share of its weight."""
    totals = h.groupBy(key).agg(F.sum("w").alias("total"))
    ranked = h.join(totals, key).withColumn("share", F.col("w") / F.col("total")).withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(F.col("w").desc(), "bin")))
    return ranked.filter((F.col("k") <= k) & (F.col("share") >= least))


def loud(df: DataFrame, key: str, level: str, floor: float) -> DataFrame:
    """Rows within `floor` of the key's largest finite level; none where all are silent."""
    finite = (F.col(level) > float("-inf")) & ~F.isnan(level)
    top = df.filter(finite).groupBy(key).agg(F.max(level).alias("top"))
    return df.join(top, key).filter(finite & (F.col(level) >= F.col("top") + floor)).drop("top")


def spread(df: DataFrame, key: str, value: str) -> DataFrame:
    x = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), F.col(value))
    return df.groupBy(key).agg(F.count("*").alias("windows"), F.round(F.avg(x), 2).alias("mean"), F.round(F.stddev_pop(x), 2).alias("spread"), F.round(F.max(x) - F.min(x), 2).alias("span"))


def worst(df: DataFrame, key: str, error: str) -> DataFrame:
    """Largest error by key; NaN is passed over and nothing is 0."""
    return df.groupBy(key).agg(F.coalesce(F.max(F.when(~F.isnan(error), F.col(error))), F.lit(0.0)).alias("worst"))


def first_windows(df: DataFrame, key: str, start: str, k: int) -> DataFrame:
    """The first k windows of each key."""
    return df.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(start))).filter(F.col("k") <= k).drop("k")


def worst_deviation(df: DataFrame, predicted: str, measured: str, limit: float = 0.02) -> DataFrame:
    """One row: the largest absolute deviation, and whether the prediction survives it."""
    return df.agg(F.max(F.abs(F.col(predicted) - F.col(measured))).alias("worst")).withColumn("survives", F.coalesce(F.col("worst") < limit, F.lit(False)))
