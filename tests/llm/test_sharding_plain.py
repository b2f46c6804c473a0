"""Label propagation against a plain version with the same draws."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from aurigraph.llm import sharding
from aurigraph.llm.common import unit


def by_hand(spark, rows: list[tuple], shards: int) -> Counter:
    """(doc_id, crc, shard, slot) of rows (doc_id, text); hashes and draws are Spark's, all else is written out."""
    text = F.coalesce("text", F.lit(""))
    base = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("g"))
    draws = [unit("doc_id", "g", seed=sharding.SEED + k).alias(f"own{k}") for k in range(sharding.ROUNDS)] + [unit("g", seed=sharding.SEED + k).alias(f"all{k}") for k in range(sharding.ROUNDS)]
    ties = [F.xxhash64("g", F.lit(s)).alias(f"tie{s}") for s in range(shards)]
    start = F.pmod(F.xxhash64("doc_id", "g", F.lit(sharding.SEED)), F.lit(shards)).cast("int").alias("start")
    docs = [r.asDict() | {"label": r.start} for r in base.select("*", start, *draws, *ties).collect()]
    total = len(docs)
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    sizes = Counter(d["g"] for d in docs)
    linked = [d for d in docs if sizes[d["g"]] > 1]
    for k in range(sharding.ROUNDS):
        counts = defaultdict(Counter)
        for d in linked:
            counts[d["g"]][d["label"]] += 1
        tie = {d["g"]: d for d in linked}
        best = {g: max((c, tie[g][f"tie{s}"], s) for s, c in own.items()) for g, own in counts.items()}
        load, leaving, asked = Counter(d["label"] for d in linked), Counter(), Counter()
        for d in linked:
            pull, _, goal = best[d["g"]]
            if d["label"] != goal:
                leaving[d["label"]] += 1
                asked[goal, int(math.log2(pull))] += 1
        share = {}
        for (goal, size), n in asked.items():
            room = quotas[goal] - load[goal] + leaving[goal]
            larger = sum(m for (other, s), m in asked.items() if other == goal and s > size)
            share[goal, size] = max(0.0, min(1.0, (room - larger) / n))
        moved = 0
        for d in linked:
            pull, _, goal = best[d["g"]]
            draw = d[f"own{k}"] if sizes[d["g"]] > max(1, min(quotas) // 4) else d[f"all{k}"]
            if d["label"] != goal and draw < share[goal, int(math.log2(pull))]:
                d["label"] = goal
                moved += 1
        if not moved:
            break
    have = Counter(d["label"] for d in docs)
    short = [s for s in range(shards) for _ in range(quotas[s] - have[s])]  # open places, shard by shard
    taken, found, spare = Counter(have), Counter(), 0
    for s in range(shards):
        own = sorted((d for d in docs if d["label"] == s), key=lambda d: (sizes[d["g"]] == 1, d["g"], d["doc_id"] is not None, d["doc_id"] or 0))
        for place, d in enumerate(own):
            if place < quotas[s]:
                found[d["doc_id"], d["crc"], s, place] += 1
            else:
                goal = short[spare]
                found[d["doc_id"], d["crc"], goal, taken[goal]] += 1
                taken[goal] += 1
                spare += 1
    return found


@pytest.mark.parametrize("shards", [6, 40])
def test_propagation_is_the_plain_one(spark, shards):
    r = random.Random(21)
    texts = [f"group {k}" for k in range(25) for _ in range(r.choice([2, 2, 3, 5, 9, 30]))] + [f"alone {k}" for k in range(140)] + [None, "", None]
    r.shuffle(texts)
    rows = [(None if i % 50 == 7 else i, t) for i, t in enumerate(texts)] + [(500, "same row"), (500, "same row")]
    found = sharding.digest(sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shards=shards)).collect()
    assert Counter((x.doc_id, x.text_crc32, x.shard, x.slot) for x in found) == by_hand(spark, rows, shards)


def test_groups_that_fit_are_whole(spark):
    """With room to spare no group of equal texts is divided."""
    texts = [f"group {k}" for k in range(60) for _ in range(2 + k % 4)] + [f"alone {k}" for k in range(800)]
    rows = sharding.shard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shards=8).collect()
    places = defaultdict(set)
    for x in rows:
        places[texts[x.doc_id]].add(x.shard)
    assert all(len(s) == 1 for s in places.values())
