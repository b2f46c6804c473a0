"""Structured Streaming over event and answer files: windows with late data, sessions, and scoring as answers arrive."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import score as S
from ..sources import committed

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, folder: str, schema: str = EVENTS, kind: str = "parquet", files_at_once: int = 100) -> DataFrame:
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_at_once).load(folder)


def counts(events: DataFrame, width: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and means by window and type; rows later than `late` are dropped by the watermark."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(window, "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def once(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def score_arrivals(answers: DataFrame, items: DataFrame) -> DataFrame:
    """Arriving answers (item_id, answer) scored against the static items; a stream-static join keeps no state."""
    from ..functions import text as T

    joined = answers.join(items, "item_id").withColumn("claim", T.final_azimuth(F.coalesce("answer", F.lit("")))).withColumn("predicted", T.signed(F.col("claim")))
    return S.flagged(joined).drop("claim")


def collect_missing(items: DataFrame, folder: str, answer: Callable[[DataFrame], DataFrame]) -> int:
    """Resumable collection: only items without an answer in the folder are answered, and appended. Returns how many.

    Answers are committed as one version after the one that was read, so a run that is killed leaves none of them, and of two runs at
    once the later fails with a conflict instead of answering an item twice.
    """
    spark = items.sparkSession
    version = committed.manifest(folder)["version"]
    done = committed.read(spark, folder).select(F.from_json("line", "item_id long")["item_id"].alias("item_id"))
    todo = items.join(done, "item_id", "left_anti")
    n = todo.count()
    if n:
        lines = answer(todo).select(F.lit("").alias("output"), committed.as_json("item_id", "answer").alias("line"))
        committed.write(lines, folder, f"answers-{uuid.uuid4().hex}", expect=version)
    return n


def run_now(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append"):
    """Write what is there as parquet with exactly-once bookkeeping, and stop."""
    query = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def offline_answerer(df: DataFrame) -> DataFrame:
    """A stand-in for a model: answers from the measured evidence, as a map over batches that any provider can take the place of."""
    return df.withColumn("answer", S.prose(F.col("estimated_azimuth_deg"), F.col("instrument")))
