"""Scores of answers against labelled items, reports, baselines and the statistics over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import numfmt as N
from ..functions import text as T
from ..sources.shared import stored
from . import verify as V
from .signals import spread

TOLERANCE_DEG = 5.0
SIDES = ("left", "right", "center")


#: Ids with several answers that are broadcast at most.
BROADCAST_ROWS = 4_000_000


def read_each(answers: DataFrame, said: dict[str, Column], order: str | None = None) -> DataFrame:
    """(item_id, *said): what the last answer of each item says, so that a repeated answer doesn't repeat its item.

    said is read where the answers are, spread over the cores if their table is small, and only that goes to the items. The last answer
    is that of the greatest `order`, of equal ones by a hash of the text. Where nothing orders them the greatest text counts, so the texts
    of items with several answers move as well; ids alone tell which these are.
    """
    rows = spread(answers.select("item_id", "answer", *([order] if order else [])))
    found = F.struct(*[c.alias(n) for n, c in said.items()])
    if order:
        place = F.struct(order, F.xxhash64("answer"))
        return rows.select("item_id", found.alias("said"), place.alias("place")).groupBy("item_id").agg(F.max_by("said", "place").alias("said")).select("item_id", "said.*")
    several = answers.groupBy("item_id").count().filter("count > 1").select("item_id")
    n = several.count()
    if not n:
        return rows.select("item_id", found.alias("said")).select("item_id", "said.*")
    met = rows.join(F.broadcast(several.withColumn("several", F.lit(True))) if n <= BROADCAST_ROWS else several.withColumn("several", F.lit(True)), "item_id", "left")
    text = F.when(F.col("several"), F.coalesce("answer", F.lit("")))
    moved = met.select("item_id", found.alias("said"), F.coalesce(text, F.lit("")).alias("place"))
    return moved.groupBy("item_id").agg(F.max_by("said", "place").alias("said")).select("item_id", "said.*")


def score(items: DataFrame, answers: DataFrame, order: str | None = None, texts: bool = False) -> DataFrame:
    """A row for each item: a missing answer counts as an empty one, and what is not answered is wrong. The text of the answer that
    counts is a column only if asked for."""
    said = {"claim": T.final_azimuth(F.coalesce("answer", F.lit("")))} | ({"answer": F.col("answer")} if texts else {})
    read = read_each(answers, said, order).withColumn("predicted", T.signed(F.col("claim")))
    return flagged(items.join(read, "item_id", "left"))


def score_verified(items: DataFrame, evidence: DataFrame, answers: DataFrame, order: str | None = None) -> DataFrame:
    """score() with all_passed and inference_passed of each answer against the item's evidence; null for items without evidence.
    The azimuth that an answer states is read once, for the score and for the checks."""
    measured = evidence.drop("azimuth").withColumn("measured", F.lit(True))
    checked = V.verify(score(items, answers, order, texts=True).withColumn("transcript", F.coalesce("answer", F.lit(""))).join(measured, "item_id", "left"), azimuth="claim")
    return checked.withColumns({c: F.when(F.col("measured"), F.col(c)) for c in ("all_passed", "inference_passed")}).drop("transcript", "measured", "unparseable")


def flagged(df: DataFrame) -> DataFrame:
    """df (azimuth, predicted) with true_side, predicted_side, abs_error and the flags."""
    p, a = F.col("predicted"), F.col("azimuth")
    return df.withColumns({
        "true_side": G.side(a),
        "predicted_side": F.when(p.isNotNull(), G.side(p)),
        "abs_error": F.abs(p - a),
        "answered": p.isNotNull(),
        "within": F.coalesce(F.abs(p - a) <= TOLERANCE_DEG, F.lit(False)),
        "side_correct": F.coalesce(G.side(p) == G.side(a), F.lit(False)) & p.isNotNull(),
    })


def rate(flag: Column | str) -> Column:
    return F.avg((F.col(flag) if isinstance(flag, str) else flag).cast("double"))


def report_columns() -> list[Column]:
    """Rates over all items, errors over answered ones; null where there is nothing to average."""
    return [
        F.count("*").alias("items"),
        F.count_if("answered").alias("n_answered"),
        F.round(rate("answered"), 6).alias("coverage"),
        F.round(F.avg("abs_error"), 6).alias("mae"),
        F.round(F.median("abs_error"), 6).alias("median_error"),
        F.round(rate("within"), 6).alias("within_rate"),
        F.round(rate("side_correct"), 6).alias("side_rate"),
    ]


def report(scored: DataFrame, *by: str) -> DataFrame:
    return scored.groupBy(*by).agg(*report_columns())


def faithful_columns() -> list[Column]:
    """Rates over the items that were verified; null where none was."""
    return [F.round(rate("all_passed"), 6).alias("all_passed_rate"), F.round(rate("inference_passed"), 6).alias("inference_passed_rate")]


def full_report(scored: DataFrame, name: str) -> DataFrame:
    """One row: the report of score_verified(), with the rate within tolerance by true azimuth as a map of ordered entries."""
    angles = scored.groupBy("azimuth").agg(F.round(rate("within"), 6).alias("rate"))
    nested = angles.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("azimuth", "rate")))).alias("within_by_angle"))  # a row an angle
    whole = scored.agg(*report_columns(), *faithful_columns()).withColumn("name", F.lit(name)).withColumn("tolerance_deg", F.lit(TOLERANCE_DEG))
    return whole.withColumn("one", F.lit(1)).join(F.broadcast(nested.withColumn("one", F.lit(1))), "one").drop("one")


def summary_line() -> Column:
    """A line of text for a full_report() row."""
    percent = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%.1f%%", F.col(c) * 100))
    return F.concat_ws("  ", F.rpad("name", 24, " "), F.concat(F.lit("within 5 deg "), percent("within_rate")), F.concat(F.lit("side "), percent("side_rate")), F.concat(F.lit("MAE "), F.coalesce(F.when(F.col("mae").isNotNull(), F.format_string("%.2f", "mae")), F.lit("n/a")), F.lit(" deg over "), percent("coverage"), F.lit(" answered")), F.concat(F.lit("inference "), F.coalesce(percent("inference_passed_rate"), F.lit("n/a"))))


def stacked(reports: dict[str, DataFrame]) -> DataFrame:
    """One report a row, named, in one pass over the union of the scored conditions."""
    whole = None
    for name, scored in reports.items():  # each is a condition of its own
        part = scored.select(F.lit(name).alias("name"), "azimuth", "predicted", "abs_error", "answered", "within", "side_correct")
        whole = part if whole is None else whole.unionByName(part)
    return report(whole, "name")


def prose(azimuth: Column, instrument: Column) -> Column:
    side = G.side(azimuth)
    return F.when(side == "center", F.concat(F.lit("The "), instrument, F.lit(" is centred, 0 degrees to the left."))).otherwise(F.concat(F.lit("The "), instrument, F.lit(" is at "), N.fixed(F.abs(azimuth), 1), F.lit(" degrees to the "), side, F.lit(".")))


def constant_baseline(items: DataFrame, azimuth: float = 0.0) -> DataFrame:
    return score(items, items.select("item_id", prose(F.lit(azimuth), F.col("instrument")).alias("answer")))


def refusal_baseline(items: DataFrame) -> DataFrame:
    return score(items, items.select("item_id", F.lit(None).cast("string").alias("answer")).limit(0))


def hash_unit(*parts: Column) -> Column:
    """0 to 1 from the first 48 bits of sha256 of the parts joined by colons; other engines can draw the same."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 12), 16, 10).cast("double") / float(1 << 48)


def random_baseline(items: DataFrame, angles: list[float], seed: int) -> DataFrame:
    pick = F.floor(hash_unit(F.lit(str(seed)), F.col("item_id").cast("string")) * len(angles)).cast("int")
    guess = F.element_at(F.array(*map(F.lit, angles)), pick + 1)
    return score(items, items.select("item_id", prose(guess, F.col("instrument")).alias("answer")))


def front_end_baseline(items: DataFrame, evidence: DataFrame) -> DataFrame:
    """The measured evidence as the answer, to one decimal as prose has it."""
    known = items.join(evidence.select("item_id", "estimated_azimuth_deg").filter("estimated_azimuth_deg IS NOT NULL"), "item_id")
    return score(items, known.select("item_id", prose(F.col("estimated_azimuth_deg"), F.col("instrument")).alias("answer")))


def stated(items: DataFrame, answers: DataFrame, how: str = "inner") -> DataFrame:
    """(item_id, ..., true_side, said): by the first side word. inner drops items without an answer, left keeps them."""
    said = read_each(answers, {"said": T.stated_side(F.coalesce("answer", F.lit("")))})
    return items.join(said, "item_id", how).withColumn("true_side", G.side(F.col("azimuth")))


def confusion(df: DataFrame) -> DataFrame:
    return df.groupBy("true_side", "said").agg(F.count("*").alias("n"))


def balanced_accuracy(said: Column, true: Column) -> Column:
    """Mean recall of the sides; as an aggregate."""
    parts = [F.avg(F.when(true == s, F.coalesce((said == s).cast("double"), F.lit(0.0)))) for s in SIDES]
    return sum(parts[1:], parts[0]) / len(SIDES)


def macro_f1(said: Column, true: Column) -> Column:
    """Mean F1 of the sides; no statement is a miss; 0 where there is nothing to find; as an aggregate."""
    scores = []
    for s in SIDES:
        hit = F.count_if(said.eqNullSafe(s) & (true == s))
        both = F.count_if(said.eqNullSafe(s)) + F.count_if(true == s)
        scores.append(F.coalesce(F.try_divide(2.0 * hit, both), F.lit(0.0)))
    return sum(scores[1:], scores[0]) / len(SIDES)


def paired(items: DataFrame, cue: DataFrame, audio: DataFrame) -> DataFrame:
    """Items with both conditions' correctness by side, missing answers being wrong."""
    angles = read_each(cue, {"angle": T.signed_azimuth(F.coalesce("answer", F.lit("")))})
    sides = read_each(audio, {"side_said": T.stated_side(F.coalesce("answer", F.lit("")))})
    both, true = items.join(angles, "item_id", "left").join(sides, "item_id", "left"), G.side(F.col("azimuth"))
    told = both.withColumn("true_side", true).withColumn("cue_correct", F.coalesce(G.side(F.col("angle")) == true, F.lit(False)) & F.col("angle").isNotNull()).withColumn("audio_correct", F.coalesce(F.col("side_said") == true, F.lit(False)))
    return told.drop("angle", "side_said")


def _cluster_sums(rows: DataFrame, cluster: str) -> DataFrame:
    """A row for each cluster, whatever its number of items."""
    return rows.groupBy(cluster).agg(F.count("*").alias("n"), F.sum(F.col("cue_correct").cast("double")).alias("cue"), F.sum(F.col("audio_correct").cast("double")).alias("audio"))


def _intervals(means: DataFrame) -> DataFrame:
    ends = [F.round(F.percentile(c, F.lit(p)), 6).alias(f"{c}_{n}") for c in ("cue", "audio", "gap") for n, p in (("low", 0.025), ("high", 0.975))]
    return means.withColumn("gap", F.col("cue") - F.col("audio")).agg(*ends)


def cluster_bootstrap(rows: DataFrame, cluster: str, samples: int, seed: int) -> DataFrame:
    """Percentile interval of the paired gap, clusters drawn with replacement.

    Rows are first summed by cluster, so replicates draw clusters (samples x clusters rows), never items; a draw is a hash of
    seed, replicate and number, which makes reruns agree on any engine. For clusters of a few hundred; bootstrap_many() else.
    """
    numbered = _cluster_sums(rows, cluster).withColumn("k", F.row_number().over(Window.orderBy(F.col(cluster).cast("string"))) - 1)
    count = numbered.count()
    draws = rows.sparkSession.range(samples).select(F.col("id").alias("replicate"), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("draw"))
    picked = draws.withColumn("k", F.floor(hash_unit(F.lit(str(seed)), F.col("replicate").cast("string"), F.col("draw").cast("string")) * count).cast("int"))
    return _intervals(picked.join(numbered, "k").groupBy("replicate").agg((F.sum("cue") / F.sum("n")).alias("cue"), (F.sum("audio") / F.sum("n")).alias("audio")))


#: Clusters whose sums are broadcast at most.
BROADCAST_CLUSTERS = 4_000_000


def bootstrap_many(rows: DataFrame, cluster: str, samples: int, seed: int) -> DataFrame:
    """cluster_bootstrap() for any number of clusters: the draws of a replicate are a generator seeded by it, in one task, from the
    broadcast sums of the clusters. Beyond BROADCAST_CLUSTERS each cluster draws instead how often it comes into each replicate
    (Poisson), and sums are added by replicate, which has the same limit for many clusters."""
    sums = stored(_cluster_sums(rows, cluster), "cluster-sums")
    spark = rows.sparkSession
    order = sums.select(F.xxhash64(F.col(cluster).cast("string")).alias("h"), "n", "cue", "audio")
    if sums.count() > BROADCAST_CLUSTERS:
        return _intervals(_poisson(order, samples, seed))
    table = order.orderBy("h", "n", "cue", "audio").toArrow()
    held = spark.sparkContext.broadcast(np.column_stack([table.column(c).to_numpy() for c in ("n", "cue", "audio")]).astype(float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = held.value
        for batch in batches:
            found = []
            for replicate in batch.column("id").to_pylist():
                times = np.bincount(np.random.default_rng([seed, replicate]).integers(0, len(values), len(values)), minlength=len(values)) if len(values) else np.zeros(0)
                n, cue, audio = times @ values
                found.append((cue / n, audio / n) if n else (None, None))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.float64()) for i in range(2)], names=["cue", "audio"])

    return _intervals(spark.range(samples).repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, "cue double, audio double"))


def _poisson(sums: DataFrame, samples: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((samples, 3))
        for batch in batches:
            values = np.column_stack([batch.column(c).to_numpy() for c in ("n", "cue", "audio")]).astype(float)
            for h, own in zip(batch.column("h").to_pylist(), values):
                total += np.outer(np.random.default_rng([seed, h & 0xFFFFFFFFFFFFFFFF]).poisson(1.0, samples), own)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(samples)), *(pa.array(total[:, i]) for i in range(3))], names=["replicate", "n", "cue", "audio"])

    parts = sums.mapInArrow(run, "replicate long, n double, cue double, audio double")
    return parts.groupBy("replicate").agg(F.try_divide(F.sum("cue"), F.sum("n")).alias("cue"), F.try_divide(F.sum("audio"), F.sum("n")).alias("audio"))
