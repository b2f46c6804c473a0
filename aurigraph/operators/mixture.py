"""Scores of mixtures: several sources an item, matched greedily within a tolerance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import geometry as G
from ..functions import numfmt as N
from ..functions import text as T
from .score import read_each

TOLERANCE_DEG = 5.0


def prose(azimuths: Column) -> Column:
    def part(a: Column) -> Column:
        return F.when(G.side(a) == "center", "one source centred, 0 degrees to the left").otherwise(F.concat(F.lit("one source at "), N.fixed(F.abs(a), 1), F.lit(" degrees to the "), G.side(a)))

    said = F.concat(F.lit("I hear "), F.size(azimuths).cast("string"), F.lit(" sources: "), F.array_join(F.transform(azimuths, part), "; "), F.lit("."))
    return F.when(F.size(azimuths) == 0, "There is only one instrument, centred.").otherwise(said)


def score(items: DataFrame, answers: DataFrame) -> DataFrame:
    """items (item_id, azimuths) with predicted azimuths, matches and the flags; a missing answer predicts nothing."""
    read = read_each(answers, {"said": T.signed_azimuths(F.coalesce("answer", F.lit("")))})
    told = items.join(read, "item_id", "left").withColumn("predicted", F.coalesce("said", F.array().cast("array<double>"))).drop("said")
    return flagged(told)


def flagged(df: DataFrame) -> DataFrame:
    true, said = F.size("azimuths"), F.size("predicted")
    hit = df.withColumn("matched", A.greedy_matches(F.col("azimuths"), F.col("predicted"), TOLERANCE_DEG))
    return hit.withColumns({
        "answered": said > 0,
        "count_correct": true == said,
        "recall": F.try_divide(F.col("matched").cast("double"), true),
        "precision": F.when(said > 0, F.col("matched") / said),
        "exact": (F.col("matched") == true) & (true == said),
    })


def report(scored: DataFrame, *by: str) -> DataFrame:
    """Means of items' own rates; precision over answered items."""
    return scored.groupBy(*by).agg(F.count("*").alias("items"), F.count_if("answered").alias("answered"), F.round(F.avg(F.col("exact").cast("double")), 6).alias("exact_rate"), F.round(F.avg(F.col("count_correct").cast("double")), 6).alias("count_rate"), F.round(F.avg("recall"), 6).alias("mean_recall"), F.round(F.avg("precision"), 6).alias("mean_precision"))


def constant_count(items: DataFrame, count: int, spacing: float = 10.0) -> DataFrame:
    """Always so many sources, spread evenly about the centre."""
    azimuths = F.array(*[F.lit((count - 1) / 2 * spacing - i * spacing) for i in range(count)])
    return score(items, items.select("item_id", prose(azimuths).alias("answer")))
