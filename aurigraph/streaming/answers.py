"""Answers that arrive as a stream and may come again: of each item the last one counts, as in the batch report.

The state of an item is its last answer, an aggregate that Spark keeps for a time to live; an arrival that is not later changes nothing.
What changes is appended to a committed log, a job for each batch of the query, so a batch that runs again after a failure adds nothing.
The report reads the last entry of each item from the log and joins it to the items, so an item counts once, and without an answer too.
When an item's state has expired an old answer can enter the log again, but not the report, which goes by the place as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import score as S
from ..sources import committed

CHANGES = "item_id long, place long, answer string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How long the place of an item's last answer is remembered, at least; at most twice that time.
TTL_MS = 7 * 24 * 3600 * 1000


def changes(answers: DataFrame, order: str = "place", ttl_ms: int = TTL_MS) -> DataFrame:
    """The stream (item_id, place, answer) of answers later than what an item had; equal places go by the text.

    Time is the time of the batch, in slots as long as the time to live. An answer belongs to the windows of two slots that begin with its
    slot and with the one before. It is told when it is the last of the latter window and came with this batch, so what an item had in
    this slot and in the one before is remembered, and a window is dropped once it has ended.
    """
    answers.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    told = answers.select(F.col("item_id").cast("long").alias("item_id"), F.col(order).cast("long").alias("place"), "answer", F.current_timestamp().alias("arrived")).withWatermark("arrived", "0 seconds")
    slots = F.window("arrived", f"{2 * ttl_ms} milliseconds", f"{ttl_ms} milliseconds")
    came = F.unix_millis("arrived")  # of equal answers the one that came first
    last = told.groupBy("item_id", slots.alias("slots")).agg(F.max(F.struct("place", F.coalesce("answer", F.lit("")).alias("text"), (-came).alias("before"), "answer")).alias("last"))
    now = F.current_timestamp()
    ending = F.unix_millis(F.col("slots.end")) - F.unix_millis(now) <= ttl_ms
    return last.filter(ending & (F.col("last.before") == -F.unix_millis(now))).select("item_id", "last.place", "last.answer")


def collect(answers: DataFrame, log: str, checkpoint: str, order: str = "place", ttl_ms: int = TTL_MS, name: str = "answers") -> None:
    """Append what changes to the log until all that is there has been read; go on later with the same checkpoint."""

    def keep(batch: DataFrame, number: int) -> None:
        committed.write(batch.select(F.lit("").alias("output"), committed.as_json("item_id", "place", "answer").alias("line")), log, f"{name}-{number}")  # no line, no version

    committed.register(answers.sparkSession)
    query = changes(answers, order, ttl_ms).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def latest(spark: SparkSession, log: str) -> DataFrame:
    """(item_id, place, answer): the last entry of each item in the log."""
    rows = committed.read(spark, log).select(F.from_json("line", CHANGES).alias("r")).select("r.*")
    return rows.groupBy("item_id").agg(F.max_by(F.struct("place", "answer"), F.struct("place", F.coalesce("answer", F.lit("")))).alias("last")).select("item_id", "last.*")


def report(items: DataFrame, log: str, *by: str) -> DataFrame:
    """score.report() of the items and the log as it is."""
    return S.report(S.score(items, latest(items.sparkSession, log).drop("place")), *by)
