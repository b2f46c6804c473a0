"""Variant records, last answers in a stream, aggregates that merge."""

from __future__ import annotations

import json
import time

import pytest
from pyspark.sql import functions as F

from aurigraph.operators import aggregates as A
from aurigraph.operators import score as S
from aurigraph.sources import committed, variants
from aurigraph.streaming import answers, events


def test_records_of_every_shape(spark, tmp_path):
    lines = [
        {"item_id": "a", "build_id": "b1", "answer_side": "left", "answer_azimuth_deg": 10, "render": {"instrument": "cello"}, "measured_evidence": {"ild_db": 1.5, "new": [1, {"x": 2}]}},
        {"item_id": "b", "build": {"id": "b2"}, "question": {"answer_side": "right", "answer_azimuth_deg": -5.5}, "instrument": "flute"},
        {"item_id": "c", "question": {"answer_azimuths_deg": [3.0, 4.0]}, "version": 9},
    ]
    (tmp_path / "l.jsonl").write_text("\n".join([json.dumps(x) for x in lines] + ["", "{broken", "[1, 2]", "17"]))
    read = variants.lines(spark, str(tmp_path / "l.jsonl"))
    assert sorted(r.bad for r in read.filter("bad IS NOT NULL").collect()) == ["17", "[1, 2]", "{broken"]
    good = read.filter("record IS NOT NULL")
    rows = {r.item_id: r for r in variants.labels(good).select("item_id", "build_id", "answer_side", "azimuth", "instrument", variants.measure("evidence", "ild_db").alias("ild")).collect()}
    assert tuple(rows["a"])[1:] == ("b1", "left", 10.0, "cello", 1.5) and tuple(rows["b"])[1:] == ("b2", "right", -5.5, "flute", None) and rows["c"].azimuth == 3.0
    assert {r.item_id: r.azimuths for r in variants.mixture_labels(good).select("item_id", "azimuths").collect()} == {"a": [10.0], "b": [-5.5], "c": [3.0, 4.0]}
    good.write.parquet(str(tmp_path / "v"))
    back = spark.read.parquet(str(tmp_path / "v"))
    assert back.select(F.try_variant_get("record", "$.version", "int").alias("v")).filter("v = 9").count() == 1
    found = variants.entries(back, "record", "$.measured_evidence").select("name", F.col("value").cast("string")).collect()
    assert {(r[0], r[1]) for r in found} == {("ild_db", "1.5"), ("new", '[1,{"x":2}]')}


def test_the_stream_reports_as_the_batch_does(spark, tmp_path):
    """Repeated answers, late ones, a restart and a batch that runs again."""
    items = spark.range(12).select(F.col("id").alias("item_id"), (F.col("id") * 5 - 25).cast("double").alias("azimuth"), F.lit("cello").alias("instrument"))
    told = lambda i, a: (i, f"It is at {abs(a)} degrees to the {'left' if a > 0 else 'right'}.")
    batches = [
        [(*told(1, -20), 1), (*told(2, 7), 2), (*told(2, -15), 3), (*told(3, 10), 4)],
        [(*told(1, 9), 6), (*told(3, -10), 2), (*told(4, -5), 7), (4, None, 5)],
        [(*told(2, 30), 9), (*told(2, -14), 8), (*told(8, 15), 9), (*told(99, 1), 9)],
    ]
    source, log, checkpoint = str(tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "check")
    seen = []
    last = {}
    for batch in batches:
        frame = spark.createDataFrame(batch, "item_id long, answer string, place long")
        frame.coalesce(1).write.mode("append").parquet(source)
        seen += batch
        stream = events.read(spark, source, "item_id long, answer string, place long", files_at_once=1)
        answers.collect(stream, log, checkpoint)
        last = {}
        for item, text, place in seen:
            if item not in last or (place, text or "") > last[item][:2]:
                last[item] = (place, text or "", text)
        assert {r.item_id: (r.place, r.answer) for r in answers.latest(spark, log).collect()} == {i: (p, t) for i, (p, _, t) in last.items()}
    want = S.report(S.score(items, spark.createDataFrame([(i, t) for i, (_, _, t) in last.items()], "item_id long, answer string")))
    found = answers.report(items, log).collect()
    assert [tuple(r) for r in found] == [tuple(r) for r in want.collect()] and found[0].items == 12
    version = committed.manifest(log)["version"]
    answers.collect(events.read(spark, source, "item_id long, answer string, place long"), log, checkpoint)
    again = spark.createDataFrame([(1, 99, "x")], answers.CHANGES).select(F.lit("").alias("output"), committed.as_json("item_id", "place", "answer").alias("line"))
    committed.write(again, log, "answers-0")
    assert committed.manifest(log)["version"] == version and answers.latest(spark, log).filter("place = 99").isEmpty()
    entries = committed.read(spark, log).count()
    assert entries == 8  # late and lesser answers never got there


def test_state_of_answers_is_kept_by_spark_and_expires(spark, tmp_path):
    """No Python call a key; within the time to live a lesser answer adds nothing, long after it only an entry."""
    source, log, checkpoint = (str(tmp_path / n) for n in ("in", "log", "check"))
    rows = spark.range(20_000).select(F.col("id").alias("item_id"), F.lit("a").alias("answer"), F.lit(5).cast("long").alias("place"))
    late = spark.createDataFrame([(1, "b", 4)], rows.schema)
    stream = lambda: events.read(spark, source, "item_id long, answer string, place long")
    rows.write.mode("append").parquet(source)
    assert "Pandas" not in answers.changes(stream())._jdf.queryExecution().logical().toString()
    answers.collect(stream(), log, checkpoint)
    late.write.mode("append").parquet(source)
    answers.collect(stream(), log, checkpoint)
    assert committed.read(spark, log).count() == 20_000
    log, checkpoint = log + "-short", checkpoint + "-short"
    for at in range(4):
        late.withColumn("place", F.lit(9 - at).cast("long")).write.mode("append").parquet(source + "-short")
        answers.collect(events.read(spark, source + "-short", "item_id long, answer string, place long"), log, checkpoint, ttl_ms=100)
        time.sleep(0.3)
    assert committed.read(spark, log).count() == 4 and answers.latest(spark, log).first().place == 9


@pytest.fixture(scope="module")
def weighted(spark):
    rows = [("a", float(i % 50), float(i % 7)) for i in range(1000)] + [("b", 1.0, 1.0), ("b", 2.0, 1.0), ("b", 3.0, 2.0), ("c", 5.0, 0.0), ("d", None, 1.0), ("d", 7.0, None), ("d", 8.0, 1.0), (None, 4.0, 1.0), ("e", float("nan"), 5.0), ("e", 1.0, 1.0)]
    return spark.createDataFrame(rows, "k string, v double, w double").repartition(5)


def test_weighted_medians_merge(spark, weighted, monkeypatch):
    plain = {}
    for k, v, w in weighted.collect():
        if v is not None and w:
            plain.setdefault(k, []).append((v, w))

    def by_hand(pairs):
        pairs, half, total = sorted(pairs, key=lambda p: (p[0] != p[0], p[0])), sum(w for _, w in pairs) / 2, 0.0
        for v, w in pairs:
            total += w
            if total >= half:
                return v

    want = {k: m for k, p in plain.items() if (m := by_hand(p)) == m}
    assert set(plain) - set(want) == {"e"}  # NaN is null
    same = lambda rows: {k: m for k, m in rows if m is not None} == want
    assert same(map(tuple, A.weighted_median(weighted, "k", "v", "w").collect()))
    monkeypatch.setattr(A, "HELD", 10)
    assert same(map(tuple, A.weighted_median(weighted, "k", "v", "w").collect()))
    A.register(spark)
    weighted.createOrReplaceTempView("weighted_rows")
    assert same(map(tuple, spark.sql("SELECT k, cue_weighted_median(v, w) FROM weighted_rows WHERE v IS NOT NULL AND w IS NOT NULL GROUP BY k").collect()))
    merged = spark.sql("SELECT k, cue_weighted_median(values, weights) FROM cue_runs(TABLE(SELECT k, v, w FROM weighted_rows)) GROUP BY k")
    assert same(map(tuple, merged.collect()))
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange hashpartitioning") < plan.index("PythonUDTF")  # runs are made below the shuffle


def test_medians_of_large_groups_stay_out_of_python(spark, weighted):
    """The same medians as the aggregate's, groups without weight too, and no Python above the runs."""
    rows = weighted.unionByName(spark.createDataFrame([("n", -3.5, 1.0), ("n", -0.25, 0.5), ("n", 9.0, 0.25), ("i", float("-inf"), 1.0), ("i", 1e300, 2.0), ("s", 1.0, 0.1), ("s", 1.0 + 1e-9, 0.7), ("s", 1.0 + 2e-9, 0.2)], weighted.schema))
    made = A.runs(rows, "k", "v", "w")
    want = {tuple(r) for r in made.groupBy("k").agg(A.cue_weighted_median("values", "weights")).collect()}
    found = A.medians_of_runs(made, "k")
    assert {tuple(r) for r in found.collect()} == want and ("c", None) in want and ("e", None) in want
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


def test_sketches_merge_in_any_order(spark):
    rows = spark.range(40_000).select((F.col("id") % 4).alias("build"), (F.col("id") % 3).alias("split"), F.when(F.col("id") % 500 == 0, None).otherwise(F.pmod(F.hash("id"), F.lit(9000)) / 7.0).alias("answer"))
    states = A.sketched(rows, "answer", "build", "split")
    one = A.merged(states, "split")
    two = A.merged(A.merged(states.orderBy(F.desc("build")), "build", "split"), "split")
    exact = rows.filter("answer IS NOT NULL").groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("answer").alias("d"))
    for state in (one, two):
        told = state.select("split", "n", A.distinct_answers().alias("about"), A.answer_quantile(0.5).alias("mid"), A.answers_below(F.lit(300.0)).alias("below"))
        for r in told.join(exact.withColumnRenamed("n", "n_exact"), "split").collect():
            assert r.n == r.n_exact and abs(r.about / r.d - 1) < 2 * A.COUNT_ERROR
            at = rows.filter(f"split = {r.split} AND answer IS NOT NULL").agg(F.avg((F.col("answer") <= r.mid).cast("double")), F.avg((F.col("answer") <= 300.0).cast("double"))).first()
            assert abs(at[0] - 0.5) < A.RANK_ERROR and abs(at[1] - r.below) < A.RANK_ERROR
