"""Balanced label propagation into shards, on DataFrame functions only.

Documents with equal texts are linked. Labels (shards) start from a hash of id and text, and draws and orders go by them too, so
reruns and other partitions of the same rows agree. In each round every linked document asks
to move to the shard that holds most of its neighbours; per shard and size of pull the requests are counted, and the share that
the shard's quota leaves room for is admitted, large pulls first. Documents without links never move for a neighbour: they are
the ballast that fills each shard to its quota at the end. The law is `rows`: the shards' counts are at most one apart.

Links are held as (group, label) counts, never as pairs. A group that is too large for one shard is divided by rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import meet, stored, unit

SHARDS = 40
ROUNDS = 8
SEED = 5


def _bin(column) -> F.Column:
    return F.floor(F.log2(column)).cast("int")


def _round(linked: DataFrame, quotas: list[int], total: int, number: int) -> DataFrame:
    """linked (row, doc_id, g, label) with the labels after one round, and whether the row moved."""
    shards = len(quotas)
    counts = linked.groupBy("g", "label").agg(F.count("*").alias("c"))
    best = counts.groupBy("g").agg(F.max(F.struct("c", F.xxhash64("g", "label").alias("tie"), "label")).alias("top"), F.sum("c").alias("n")).select("g", "n", F.col("top.label").alias("best"), F.col("top.c").alias("pull"))
    wish = stored(meet(linked.select("row", "doc_id", "g", "label"), best, "g", "n", total), "sharding-wishes")
    asks = wish.filter("label <> best").groupBy("label", "best", _bin(F.col("pull")).alias("bin")).agg(F.count("*").alias("asked"))
    load = {r["label"]: r["n"] for r in wish.groupBy("label").agg(F.count("*").alias("n")).collect()}  # one number for each shard
    leaving = {r["label"]: r["n"] for r in asks.groupBy("label").agg(F.sum("asked").alias("n")).collect()}
    room = F.element_at(F.array(*[F.lit(quotas[s] - load.get(s, 0) + leaving.get(s, 0)).cast("double") for s in range(shards)]), F.col("best") + 1)
    wanted = asks.groupBy("best", "bin").agg(F.sum("asked").alias("asked"))  # shards times bins: bounded
    larger = F.coalesce(F.sum("asked").over(Window.partitionBy("best").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    admitted = wanted.select("best", "bin", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (room - larger) / F.col("asked"))).alias("share"))
    # a group that is small beside a shard moves as one, a larger one by rows
    draw = F.when(F.col("n") > F.lit(max(1, min(quotas) // 4)), unit("doc_id", "g", seed=SEED + number)).otherwise(unit("g", seed=SEED + number))
    moved = (F.col("label") != F.col("best")) & (draw < F.coalesce("share", F.lit(0.0)))
    after = wish.withColumn("bin", _bin(F.col("pull"))).join(F.broadcast(admitted), ["best", "bin"], "left")
    return after.select("row", "doc_id", "g", F.when(moved, F.col("best")).otherwise(F.col("label")).alias("label"), moved.alias("moved"))


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with `place`, from 0 without gaps in each label: linked rows first, group by group, then the rest.

    Rows are dealt by ranges of the sort key, numbered in each range and shifted by what the label has in ranges before.
    """
    pieces = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = ["label", F.col("ballast"), "g", "doc_id", "row"]  # rows of one id and text are alike, so `row` settles nothing that shows
    dealt = stored(rows.repartitionByRange(pieces, *key).withColumn("piece", F.spark_partition_id()), "sharding-places")
    counts = dealt.groupBy("label", "piece").agg(F.count("*").alias("n"))  # a label's ranges meet in few rows
    shift = F.coalesce(F.sum("n").over(Window.partitionBy("label").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("label", "piece", shift.alias("shift"))
    within = F.row_number().over(Window.partitionBy("label", "piece").orderBy("ballast", "g", "doc_id", "row")) - 1
    return dealt.join(offsets, ["label", "piece"]).withColumn("place", (within + F.col("shift")).cast("long"))


def _step(bounds: list[int], value) -> F.Column:
    """Index of the first bound above value."""
    out = F.lit(len(bounds) - 1)
    for i in range(len(bounds) - 2, -1, -1):
        out = F.when(value < bounds[i], i).otherwise(out)
    return out


def _level(labelled: DataFrame, quotas: list[int]) -> DataFrame:
    """Exact quotas: what is beyond a shard's quota (ballast first) fills the shards that are short, in order."""
    shards = len(quotas)
    have = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    spare, short, over_before, short_after = 0, 0, [], []
    for s in range(shards):
        over_before.append(spare)
        spare += max(0, have.get(s, 0) - quotas[s])
        short += max(0, quotas[s] - have.get(s, 0))
        short_after.append(short)

    def of(values: list[int], index) -> F.Column:
        return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), index + 1)

    label, place = F.col("label"), F.col("place")
    placed = _numbered(labelled).withColumn("spare", F.when(place >= of(quotas, label), of(over_before, label) + place - of(quotas, label)))
    goal = _step(short_after, F.col("spare"))
    shard = F.when(F.col("spare").isNull(), label).otherwise(goal).cast("int")
    before = [b - max(0, quotas[s] - have.get(s, 0)) for s, b in enumerate(short_after)]
    slot = F.when(F.col("spare").isNull(), place).otherwise(of([have.get(s, 0) for s in range(shards)], goal) + F.col("spare") - of(before, goal))
    return placed.withColumn("shard", shard).withColumn("slot", slot.cast("long"))


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, linked, shard, slot): one row for each row of docs.

    Counts of shards are at most one apart, the first shards having the one more. Null texts count as empty ones, so all null
    and empty texts are one group; repeated rows are linked rows as any others; with fewer rows than shards the last shards are
    empty; an empty table gives no rows. Ids need not be distinct, and null ids are kept. Equal rows get different slots, and
    which of them gets which does not show. At most `rounds` rounds are run; groups that have not gathered by then stay divided,
    and the quotas hold in any case. Other columns play no part.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("g")).withColumn("row", F.monotonically_increasing_id()), "sharding-base")
    total = base.count()
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    groups = stored(base.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1"), "sharding-groups")
    start = F.pmod(F.xxhash64("doc_id", "g", F.lit(SEED)), F.lit(shards)).cast("int")
    linked = stored(meet(base.select("row", "doc_id", "g"), groups, "g", "n", total).select("row", "doc_id", "g", start.alias("label")), "sharding-labels")
    for number in range(rounds if not linked.isEmpty() else 0):
        linked = stored(_round(linked, quotas, total, number), "sharding-labels")
        if linked.filter("moved").isEmpty():
            break
    known = linked.select("row", "label")
    labelled = base.join(known, "row", "left").select("doc_id", "size", "text_crc32", "g", "row", F.coalesce("label", start).alias("label"), F.when(F.col("label").isNull(), 1).otherwise(0).alias("ballast"))
    return _level(stored(labelled, "sharding-labelled"), quotas).select("doc_id", "size", "text_crc32", (F.col("ballast") == 0).alias("linked"), "shard", "slot")


def digest(sharded: DataFrame) -> DataFrame:
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
