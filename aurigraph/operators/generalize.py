"""Whether an evaluation set can tell memorised answers from computed ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import joins

ON_GRID_DEG = 0.75
TOLERANCE_DEG = 5.0


def trained_answers(grid: DataFrame, angle: str, width: float | None = 1.2) -> DataFrame:
    """(angle): the grid and where a width moves it, to four decimals, each once."""
    plain = grid.select(F.col(angle).cast("double").alias("angle"))
    if width is not None:
        moved = plain.select(F.bround(G.azimuth_after_width(F.col("angle"), F.lit(width)), 4).alias("angle")).filter("angle IS NOT NULL")
        plain = plain.unionByName(moved)
    return plain.select((F.col("angle") + 0.0).alias("angle")).distinct()


def gaps(angles: DataFrame) -> DataFrame:
    """(low, high): neighbours. angles are the distinct answers of a build, a few dozen."""
    w = Window.orderBy("angle")
    return angles.select(F.col("angle").alias("low"), F.lead("angle").over(w).alias("high")).filter("high IS NOT NULL")


def widest_gap(angles: DataFrame) -> DataFrame:
    return gaps(angles).agg(F.coalesce(F.max(F.col("high") - F.col("low")), F.lit(float("inf"))).alias("gap"))


def eval_angles(angles: DataFrame, count: int, limit: float = 25.0, decimals: int = 1) -> DataFrame:
    """(angle): the middles of the widest gaps and their mirror images, as many as asked for."""
    mid = gaps(angles.filter(F.abs("angle") <= limit)).select(((F.col("low") + F.col("high")) / 2).alias("centre"), ((F.col("high") - F.col("low")) / 2).alias("room")).filter("centre > 0")
    ranked = mid.withColumn("k", F.row_number().over(Window.orderBy(F.col("room").desc(), "centre")))
    both = ranked.filter(F.col("k") <= (count + 1) // 2).select("k", F.posexplode(F.array(-F.bround("centre", decimals), F.bround("centre", decimals))).alias("i", "angle"))
    return both.filter((F.col("k") - 1) * 2 + F.col("i") < count).select("angle")


def discriminability(evaluation: DataFrame, trained: list[float]) -> DataFrame:
    """evaluation (angle): rates of one that snaps to the trained answers and of one that computes, and what tells them apart."""
    snapped = joins.nearest_value(evaluation, "angle", trained).withColumn("error", F.abs(F.col("snapped") - F.col("angle")))
    out = snapped.agg(
        F.avg((F.col("error") <= TOLERANCE_DEG).cast("double")).alias("memorised_within"),
        F.avg("error").alias("memorised_mae"),
        F.avg(joins.within(F.col("snapped"), trained, ON_GRID_DEG).cast("double")).alias("memorised_on_grid"),
        F.avg(joins.within(F.col("angle"), trained, ON_GRID_DEG).cast("double")).alias("computed_on_grid"),
    )
    return out.withColumn("separates_on_tolerance", F.abs(F.col("memorised_within") - 1) > 0.05).withColumn("separates_on_error", F.col("memorised_mae") > 1.0).withColumn("separates_on_grid_rate", F.abs(F.col("memorised_on_grid") - F.col("computed_on_grid")) > 0.5)


def lint(angles: DataFrame, tolerance: float = TOLERANCE_DEG, least: int = 32) -> DataFrame:
    """(answers, gap, warnings) of a build's distinct answers."""
    n = angles.agg(F.count("*").alias("answers"))
    both = n.crossJoin(widest_gap(angles))
    codes = F.filter(F.array(F.when(F.col("gap") <= tolerance, F.lit("gap_within_tolerance")), F.when(F.col("answers") < least, F.lit("few_distinct_answers"))), lambda x: x.isNotNull())
    return both.withColumn("warnings", F.array_join(codes, ","))
