"""What queries hold and move as their tables grow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from aurigraph import catalog
from aurigraph.functions import dsp
from aurigraph.operators import collect as C
from aurigraph.operators import joins as J
from aurigraph.operators import quantiles as Q
from aurigraph.operators import signals as K
from aurigraph.operators import track as W

SMALL = "/root/testdata/sf0.001"


def plan(spark, query: str) -> str:
    return catalog.queries()[query](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()


def test_signals_are_handed_on_in_parts(spark, monkeypatch):
    rows, held = spark.range(1), []
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, run, schema: held.append(run) or self)
    K.noises(rows, ["id"], 8192, "id")
    ids = pa.RecordBatch.from_arrays([pa.array(range(500))], names=["id"])
    parts = list(held[0](iter([ids, ids.slice(0, 0)])))
    assert max(p.nbytes for p in parts) <= K.PART_BYTES + (1 << 17) and len(parts) > 5
    assert [i for p in parts for i in p.column("id").to_pylist()] == list(range(500))
    assert np.allclose(parts[-1].column("mono")[-1].values.to_numpy(), np.random.default_rng(499).normal(size=8192) * 0.1)
    K.pitches(rows.selectExpr("id", "array(0D) AS mono"), ["id"], 48_000, 80.0, 1000.0)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= K.PART_BYTES


def test_reverb_joins_no_signals(spark):
    assert "Join" not in plan(spark, "reverb")


def test_a_sweep_hands_on_no_signals(spark):
    assert plan(spark, "wet_sweep").count("MapInArrow") == 2  # noises, and all else


def test_a_sweep_reverberates_a_clip_once(monkeypatch):
    x, heads, known = np.random.default_rng(1).normal(size=6000) * 0.1, [], dsp.reverberation
    wet, wide = ("reverb", {"rt60_s": 0.05, "wet": 0.5}), ("midside", {"width": 1.3})
    chains = {"dry": [], "wet": [wet], "wide": [wet, wide], "late": [wide, wet], "none": [("reverb", {"rt60_s": 0.05})], "other": [("reverb", {"rt60_s": 0.05, "wet": 0.2, "seed": 3.0})]}
    want = {(c, a): dsp.process(*dsp.pan(x, a), 48_000, steps) for c, steps in chains.items() for a in (-20.0, 10.0)}
    monkeypatch.setattr(dsp, "reverberation", lambda *p: heads.append(p) or known(*p))
    got = {(c, a): (left, right) for c, a, left, right in dsp.swept(x, 48_000, (-20.0, 10.0), chains)}
    assert len(heads) == 4  # at the head: one for each seed; further on: one for each angle
    assert got.keys() == want.keys() and all(np.allclose(got[k][i], want[k][i], rtol=0, atol=1e-13) for k in want for i in (0, 1))


def test_reverberation_is_what_its_filters_make(monkeypatch):
    for n, rate, rt60_s in ((5000, 48_000, 0.05), (1, 8000, 0.3), (0, 48_000, 0.1), (3000, 1000, 0.6)):
        x, tail = np.random.default_rng(n).normal(size=n), round(1.2 * rt60_s * rate)
        level, now = [], 0.0
        for v in np.abs(x).tolist():
            level.append(now := max(v, now * np.exp(-1 / (0.02 * rate))))
        assert np.allclose(dsp.envelope(x, rate), level, rtol=1e-12, atol=0)
        noise = np.random.default_rng(7)
        want = [dsp._filtered(np.concatenate([x + noise.normal(size=n) * 0.6 * np.array(level), np.zeros(tail)]), rate, rt60_s, extra) for extra in (0, dsp.SPREAD)]
        found = dsp.reverberation(x, rate, rt60_s, 7)
        with monkeypatch.context() as m:
            m.setattr(dsp, "LONGEST_KEPT", 0)
            run = dsp.reverberation(x, rate, rt60_s, 7)
        assert all(len(a) == n + tail and np.allclose(a, b, rtol=0, atol=1e-12) and np.allclose(a, c, rtol=0, atol=1e-12) for a, b, c in zip(want, found, run))
    x = np.concatenate([np.ones(4000), [np.nan]])
    assert np.isfinite(dsp.reverberation(x, 48_000, 0.05)[0][:4000]).all()  # what comes before a bad sample stays


def test_cues_named_alone_are_those_of_all(spark):
    clips = spark.createDataFrame([(1, (np.random.default_rng(1).normal(size=9000) * 0.1).tolist()), (2, [0.0] * 9000), (3, [0.1] * 20), (4, [0.1, float("nan")] * 4500)], "id long, mono array<double>")
    chains = {"dry": [], "wet": [("reverb", {"rt60_s": 0.05, "wet": 0.5})]}
    every = {(r.id, r.chain, r.azimuth): r for r in W.sweep(clips, ["id"], 48_000, (-20.0, 10.0), chains).collect()}
    some = W.sweep(clips, ["id"], 48_000, (-20.0, 10.0), chains, ("coherence", "estimated_regime"))
    assert some.columns == ["id", "chain", "azimuth", "coherence", "estimated_regime", "problem"] and len(every) == 16
    assert {(r.id, r.chain, r.azimuth): tuple(r)[3:] for r in some.collect()} == {k: (r.coherence, r.estimated_regime, r.problem) for k, r in every.items()}
    assert every[1, "dry", 10.0].error < 1e-6 and every[1, "wet", 10.0].coherence < 0.9 < every[1, "dry", 10.0].coherence
    assert [every[i, "dry", 10.0].problem for i in (2, 3, 4)] == ["the signal is silent", "too short for an estimate of coherence", "a sample is not finite"]


def test_numbers_of_lists_may_be_long(spark):
    text = "1234567.5, -98765432101, .5, +2., 1e3, 1d, 1e, NaN, , 0x10"
    got = spark.createDataFrame([(text,)], "t string").select(C.number_list(F.col("t"))).first()[0]
    assert got == [1234567.5, -98765432101.0, 0.5, 2.0, 1000.0, None, None, None, None, None]


def test_totals_in_ranges_are_those_of_all_pairs(spark):
    nan = float("nan")
    points = spark.createDataFrame([(i, x) for i, x in enumerate([-1e30, -3.25, -1.0, 0.0, 0.001, 0.004, 0.004, 0.01, 2.5, 7.0, 7.001, 1e18, nan, None])], "k long, v double")
    ends = [None, -1e30, -3.25, -1.0, 0.0, 0.003, 0.004, 0.01, 2.0, 7.0, 1e18, nan]
    ranges = spark.createDataFrame([(i * 100 + j, a, b) for i, a in enumerate(ends) for j, b in enumerate(ends)], "span long, low double, high double")
    totals = {"n": ("count", "*"), "least": ("min", "v"), "most": ("max", "v"), "keys": ("sum", "k")}
    every = ranges.join(points, F.expr("v IS NOT NULL AND (low IS NULL OR v >= low) AND (high IS NULL OR v <= high)")).groupBy("span").agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.sum("k").alias("keys"))
    for unit in (0.01, 3.0):
        got = J.totals_in_ranges(points, ranges, "span", "v", "low", "high", unit, totals)
        assert sorted(map(str, got.collect())) == sorted(map(str, every.collect()))
    assert J.totals_in_ranges(points, ranges.limit(0), "span", "v", "low", "high", 1.0, totals).isEmpty()


def test_grid_tells_its_cues_once(spark):
    for query in ("expected_cues", "render_plan_expand"):
        above, found, grid = plan(spark, query).partition("Join Cross")
        assert found and "lambda" not in above


def test_dense_examples_are_drawn_once(spark):
    assert "Join" not in plan(spark, "dense_examples")


def test_quantiles_read_their_numbers_once(spark):
    rows = spark.range(1000).selectExpr("id % 3 AS k", "CAST(id AS DOUBLE) * 7 % 101 AS x")
    found = Q.quantiles(rows, "x", {"m": 0.5}, "k")
    assert "Range (" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rows.groupBy("k").agg(F.percentile("x", F.lit(0.5))).collect()))


def test_a_verified_answer_is_searched_for_its_azimuth_once(spark):
    from aurigraph.functions import text as T

    assert sum(T.EITHER in step for step in plan(spark, "score_verified").splitlines()) == 1
