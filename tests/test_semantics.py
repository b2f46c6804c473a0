"""Known answers: claims, checks, scores, traps of comparison and rounding, kernels, sources and streams."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from aurigraph.functions import arrays as A
from aurigraph.functions import dsp
from aurigraph.functions import geometry as G
from aurigraph.functions import numfmt as N
from aurigraph.functions import text as T
from aurigraph.operators import joins as J
from aurigraph.operators import mixture as M
from aurigraph.operators import plan as P
from aurigraph.operators import prompts as R
from aurigraph.operators import score as S
from aurigraph.operators import signals as K
from aurigraph.operators import survey as Y
from aurigraph.operators import validate as L
from aurigraph.operators import verify as V
from aurigraph.sources import records, wav
from aurigraph.streaming import events

NAN = float("nan")


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).coalesce(1).select(*columns).collect()]


CLAIMS = [
    ("The cello is at 25 degrees to the left.", 25.0), ("It is at 12.5 degrees to the right.", -12.5), ("0 degrees to the left, dead centre", 0.0), ("it sits towards the left, as the 18.0-degree azimuth shows", 18.0),
    ("left at 27.5°", 27.5), ("right, 23°", -23.0), ("centred", 0.0), ("the centre", 0.0), ("dead center", 0.0), ("centered", None), ("somewhere in the middle", None), ("", None), ("I can't tell.", None),
    ("First 5 degrees right. Then it comes to 20 degrees to the left.", 20.0), ("20 degrees leftish", 20.0), ("0 degrees to the right", 0.0), ("écentre", None),
]


def test_final_azimuth(spark):
    found = values(spark, [(t,) for t, _ in CLAIMS], "t string", T.signed_azimuth(F.col("t")))
    assert [x for (x,) in found] == [x for _, x in CLAIMS]


def test_spans_are_those_of_a_scanner(spark):
    texts = ["", "12 dB", "a 1.5 dB, b 20dB; 3 db", "no number", "5-°", "1 degrees2 degrees left", "x" * 70 + " 3 degrees " + "y" * 70 + " left"]
    for pattern in (T.BARE, T.DECIBEL, T.SENTENCE, T.ADJACENT):
        found = values(spark, [(t,) for t in texts], "t string", T.spans(F.col("t"), pattern))
        want = [[(m.start(), m.end(), m[0]) for m in re.finditer(pattern, t)] for t in texts]
        assert [[tuple(s) for s in x] for (x,) in found] == want


def test_claims(spark):
    def one(f, *texts):
        return [None if r[0] is None else r[0]["value"] for r in values(spark, [(t,) for t in texts], "t string", f(F.col("t")))]

    assert one(T.ild_claim, "3.5 dB, left louder", "3 dB and the right is louder", "3 dB", "louder left", "9 dB here" + " " * 80 + "2 dB left louder") == [3.5, -3.0, None, None, -0.0 + 2.0]
    assert one(T.itd_claim, "There is no inter-channel delay.", "300 microseconds, right channel later", "300 microseconds, left channel later", "1 microsecond", "none") == [0.0, 300.0, -300.0, 1.0, None]
    assert one(T.coherence_claim, "coherence: 0.93", "Coherence is about 0.5", "not coherent", "fully coherent", "incoherent") == [0.93, 0.5, 0.0, 1.0, None]
    assert one(T.regime_claim, "binaural, not amplitude-panned", "amplitude panning", "x") == ["delayed", "amplitude", None]
    assert one(T.f0_claim, "near 440 Hz", "440 hz", "220.5Hz.") == [440.0, None, 220.5]
    assert values(spark, [("r = 10^(19.5/20) = 9.44",), ("R=10^( -6 / 20 )=0.5",)], "t string", T.premise_claim(F.col("t"))["x"], T.premise_claim(F.col("t"))["y"]) == [(19.5, 9.44), (-6.0, 0.5)]
    assert [x for (x,) in values(spark, [("Left, not right",), ("Centre!",), ("centred",)], "t string", T.stated_side(F.col("t")))] == ["left", "center", None]


EVIDENCE = dict(estimated_azimuth_deg=25.0, ild_db=19.5, itd_us=0.0, coherence=1.0, estimated_regime="amplitude", f0_hz=NAN)


def verify(spark, text, **change):
    e = EVIDENCE | change
    schema = "transcript string, estimated_azimuth_deg double, ild_db double, itd_us double, coherence double, estimated_regime string, f0_hz double"
    return V.verify(spark.createDataFrame([(text, *(e[k] for k in ("estimated_azimuth_deg", "ild_db", "itd_us", "coherence", "estimated_regime", "f0_hz")))], schema)).first()


def test_verifier_truth_table(spark):
    good = verify(spark, "It is 25 degrees to the left. The level difference is 19.5 dB, left louder. Coherence 0.98, amplitude panning.")
    assert good.all_passed and good.inference_passed and [c.quantity for c in good.checks] == ["estimated_azimuth_deg_side", "estimated_azimuth_deg_magnitude", "ild_db", "coherence", "estimated_regime"]
    wrong = verify(spark, "It is 25 degrees to the right.")
    assert [c.passed for c in wrong.checks] == [False, True] and not wrong.all_passed
    assert verify(spark, "14 degrees to the right", estimated_azimuth_deg=0.0).checks[0].passed  # a measured centre has no side
    none = verify(spark, "Nothing to say.")
    assert not none.all_passed and not none.inference_passed and none.checks == []
    assert verify(spark, "440 Hz").checks == [] and verify(spark, "440 Hz", f0_hz=430.0).checks[0].passed and not verify(spark, "440 Hz", f0_hz=400.0).checks[0].passed
    assert not verify(spark, "20 degrees to the left", estimated_azimuth_deg=NAN).checks[1].passed  # NaN passes nothing
    assert verify(spark, "r = 10^(19.5/20) = 9.44").checks[0].passed and not verify(spark, "r = 10^(19.5/20) = 3.0").checks[0].passed and not verify(spark, "r = 10^(19.5/20) = 0").checks[0].passed
    assert verify(spark, "We saw 7 things at 19.5 dB.").unparseable == ["We saw 7 things at 19.", "5 dB."]


def test_pair_diagnostics(spark):
    rows = [(10.0, 10.0, 20.0, 20.0), (10.0, 10.0, 10.0, 20.0), (10.0, 5.0, 12.0, 5.0), (10.0, 0.0, 5.0, 10.0), (None, 0.0, 5.0, 10.0)]
    got = values(spark, rows, "a double, ma double, b double, mb double", V.perturbation_of(F.col("a"), F.col("ma"), F.col("b"), F.col("mb"))["tracked"])
    assert [x for (x,) in got] == [True, False, True, False, None]
    rows = [(25.0, None, 25.0), (25.0, 25.0, 25.0), (-25.0, None, 25.0), (None, 25.0, 25.0)]
    got = values(spark, rows, "w double, n double, m double", V.ablation_of(F.col("w"), F.col("n"), F.col("m"))["relied_on_numbers"])
    assert [x for (x,) in got] == [True, False, False, None]


def grid(spark):
    return spark.createDataFrame([(f"item_{i:03d}", float(a), "cello") for i, a in enumerate(range(-25, 30, 5))], "item_id string, azimuth double, instrument string")


def test_baselines_on_the_grid(spark):
    centre = S.report(S.constant_baseline(grid(spark))).first()
    assert (centre.within_rate, centre.mae, centre.side_rate, centre.coverage) == (pytest.approx(3 / 11, abs=1e-6), pytest.approx(150 / 11, abs=1e-6), pytest.approx(1 / 11, abs=1e-6), 1.0)
    refusal = S.report(S.refusal_baseline(grid(spark))).first()
    assert refusal.n_answered == 0 and refusal.within_rate == 0 and refusal.mae is None
    near = grid(spark).withColumn("answer", S.prose(F.col("azimuth"), F.col("instrument"))).filter(F.abs("azimuth") <= 5)
    some = S.report(S.score(grid(spark), near.select("item_id", "answer"))).first()
    assert some.coverage == some.within_rate == pytest.approx(3 / 11, abs=1e-6) and some.mae == 0


def test_tolerance_boundary(spark):
    items = spark.createDataFrame([(1, 10.0), (2, 10.0)], "item_id int, azimuth double")
    answers = spark.createDataFrame([(1, "14.9 degrees to the left"), (2, "15.1 degrees to the left")], "item_id int, answer string")
    assert [r.within for r in S.score(items, answers).orderBy("item_id").collect()] == [True, False]


def test_greedy_is_not_optimal(spark):
    rows = [([10.0, 0.0], [5.0, 10.0]), ([15.0, -15.0], [-14.0, 16.0, 40.0]), ([15.0], []), ([], [3.0])]
    got = values(spark, rows, "t array<double>, p array<double>", A.greedy_matches(F.col("t"), F.col("p"), 5.0))
    assert [x for (x,) in got] == [1, 2, 0, 0]
    said = values(spark, [([15.0, 0.0, -20.5],), ([],)], "a array<double>", M.prose(F.col("a")), T.signed_azimuths(M.prose(F.col("a"))))
    assert said[0][1] == [15.0, 0.0, -20.5] and said[1][0] == "There is only one instrument, centred."


def test_statistics(spark):
    rows = [("left", "left"), ("left", None), ("right", "left"), ("right", "right"), ("center", "right")]
    got = values(spark, rows, "t string, s string", S.balanced_accuracy(F.col("s"), F.col("t")), S.macro_f1(F.col("s"), F.col("t")))
    assert got == [(pytest.approx(1 / 3), pytest.approx((0.5 + 0.5 + 0) / 3))]


def test_bootstrap_weighs_clusters_by_rows(spark):
    rows = spark.createDataFrame([("a", True, False)] * 9 + [("b", False, False)], "c string, cue_correct boolean, audio_correct boolean")
    found = S.cluster_bootstrap(rows, "c", 300, 1).first()
    assert (found.cue_low, found.cue_high, found.audio_high) == (0.0, 1.0, 0.0)
    assert found == S.cluster_bootstrap(rows.repartition(3), "c", 300, 1).first()


def test_nan_is_no_side_and_fails_nothing(spark):
    got = values(spark, [(3.0,), (-3.0,), (0.0,), (NAN,)], "x double", G.side(F.col("x")))
    assert [x for (x,) in got] == ["left", "right", "center", "center"]
    evidence = spark.createDataFrame([(NAN, NAN, 0.95, "amplitude", 0.5, -20.0, 10.0)], "estimated_azimuth_deg double, itd_us double, coherence double, estimated_regime string, peak double, rms_db double, azimuth double")
    steps = F.array().cast("array<struct<kind: string, params: map<string, double>>>")
    assert L.validate(evidence.withColumn("expected", G.expected_cues(F.col("azimuth"), steps))).first().failures == []


def test_expected_cues(spark):
    schema = "a double, p array<struct<kind: string, params: map<string, double>>>"
    rows = [(10.0, [("midside", {"width": 1.2})]), (25.0, [("midside", {"width": 3.0}), ("midside", {"width": 0.1})]), (10.0, [("delay_widening", {"delay_us": 300.0}), ("eq", {"q": 1.0})]), (10.0, [("reverb", {"wet": 0.0})]), (10.0, [("reverb", {"wet": 0.2})])]
    got = [r[0] for r in values(spark, rows, schema, G.expected_cues(F.col("a"), F.col("p")))]
    assert got[0].azimuth_deg == pytest.approx(math.degrees(math.atan(1.2 * math.tan(math.radians(10))))) and got[1].azimuth_deg is None
    assert (got[2].itd_us, got[2].regime, got[2].azimuth_deg) == (300.0, "delayed", 10.0) and got[3].regime == "amplitude" and got[3].coherence_stays_high
    assert (got[4].azimuth_deg, got[4].regime, got[4].coherence_stays_high) == (None, None, False)
    with pytest.raises(Exception, match="unknown processing kind"):
        values(spark, [(1.0, [("warp", {"x": 1.0})])], schema, G.expected_cues(F.col("a"), F.col("p")))


def test_mixture_validation(spark):
    rows = [([10.0, -10.0], [-9.0, 12.0], 0.5, -20.0), ([10.0], [10.0, 3.0], 0.5, -20.0), ([10.0, 0.0], [20.0, 0.0], 1.5, -60.0)]
    got = L.validate_mixture(spark.createDataFrame(rows, "planted array<double>, measured array<double>, peak double, rms_db double").coalesce(1)).select("failures").collect()
    assert [r.failures for r in got] == [[], ["source_count_mismatch"], ["peak_too_high", "audio_too_quiet", "azimuth_recovery_failed"]]


def test_numbers_as_text(spark):
    xs = [0.25, 0.35, 2.675, 19.5, -0.04, 1234.5, 0.0, 1e-3]
    got = values(spark, [(x,) for x in xs], "x double", N.fixed(F.col("x"), 1), N.fixed(F.col("x"), 3))
    assert [a for a, _ in got] == [f"{x:.1f}" for x in xs] and [b for _, b in got] == [f"{x:.3f}" for x in xs]
    gs = [25.0, -2.5, 0.1, 300.0, 1234.5, 0.0, 0.000123456789, 999999.0]
    assert [x for (x,) in values(spark, [(g,) for g in gs], "x double", N.general(F.col("x")))] == [f"{g:g}" for g in gs]
    steps = [([("eq", {"q": 1.0, "gain_db": -6.0, "center_hz": 1000.0})],), ([],)]
    assert [x for (x,) in values(spark, steps, "p array<struct<kind: string, params: map<string, double>>>", N.processing_label(F.col("p")))] == ["eq_center_hz1000_gain_dbneg6_q1", "dry"]


def test_derivation_reads_back(spark):
    from aurigraph.functions.dsp import azimuth_of_ild

    rows = [(x, float(azimuth_of_ild(x))) for x in (19.5, -7.3, 3.1)]
    got = values(spark, rows, "i double, a double", R.faithful_derivation(F.col("i"), F.col("a"), F.lit("cello")), T.signed_azimuth(R.faithful_derivation(F.col("i"), F.col("a"), F.lit("cello"))))
    assert all(abs(back - a) <= 0.11 for (_, back), (_, a) in zip(got, rows))
    with pytest.raises(Exception, match="not of one render"):
        values(spark, [(19.5, -25.0)], "i double, a double", R.faithful_derivation(F.col("i"), F.col("a"), F.lit("cello")))


def test_levels_of_silence(spark):
    got = values(spark, [([0.0, 0.0], [0.0, 0.0]), ([1.0, -1.0], [1.0, -1.0]), ([], [])], "l array<double>, r array<double>", A.rms_db(F.col("l"), F.col("r")), A.side_to_total_db(F.col("l"), F.col("r")))
    assert got[0] == (-math.inf, -math.inf) and got[1] == (0.0, -math.inf) and got[2][0] is None


def test_window_starts_and_peaks(spark):
    assert [x for (x,) in values(spark, [(10,), (3,), (8,)], "n int", A.window_starts(F.col("n"), 4))] == [[0, 4], [], [0, 4]]
    assert values(spark, [([1.0, 3.0, 3.0, 2.0, 5.0],)], "d array<double>", A.local_maxima(F.col("d"))) == [([2, 4],)]
    peaks = [[(5.0, 1.0), (9.0, 2.0), (4.0, 8.0)]]
    assert [[p.x for p in r[0]] for r in values(spark, [tuple(peaks)], "p array<struct<height: double, x: double>>", A.thinned(F.col("p"), 3.0))] == [[2.0, 8.0]]
    tracks = spark.createDataFrame([(1, -10.0), (1, -45.0), (1, -math.inf), (2, -math.inf)], "t int, level double")
    assert [tuple(r) for r in Y.loud(tracks, "t", "level", -40.0).orderBy("level").collect()] == [(1, -45.0), (1, -10.0)]
    errors = spark.createDataFrame([("a", NAN), ("a", 2.0), ("b", NAN)], "c string, e double")
    assert {r.c: r.worst for r in Y.worst(errors, "c", "e").collect()} == {"a": 2.0, "b": 0.0}


def test_nearest_in_time(spark):
    frames = spark.createDataFrame([("k", 100 + i, float(i)) for i in range(10)], "key string, t int, f0 double")
    asked = spark.createDataFrame([("k", 90), ("k", 103), ("k", 112), ("other", 103), ("k", None)], "key string, t int")
    got = {(r.key, r.t): r.nearest_f0 for r in J.nearest_in_time(asked, frames, "key", "t", ["f0"], 5).collect()}
    assert got == {("k", 90): None, ("k", 103): 3.0, ("k", 112): 9.0, ("other", 103): None, ("k", None): None}
    halves = spark.createDataFrame([("k", 0.005)], "key string, t double")
    grid_ = spark.createDataFrame([("k", 0.0, 1.0), ("k", 0.01, 2.0)], "key string, t double, f0 double")
    assert J.nearest_in_time(halves, grid_, "key", "t", ["f0"], 0.005).first().nearest_f0 == 1.0  # a tie goes to the earlier


def test_splits_and_ids(spark):
    pieces = spark.createDataFrame([(i,) for i in range(44)], "piece int")
    counts = {r.split: r["count"] for r in P.assign_splits(pieces, "piece", 2026).groupBy("split").count().collect()}
    assert counts == {"train": 31, "dev": 7, "test": 6}
    ids = [r.public_id for r in P.opaque_ids(pieces, "piece", 1, "t_").collect()]
    assert sorted(ids) == [f"t_{i:05d}" for i in range(44)]
    with pytest.raises(ValueError):
        P.assign_splits(pieces, "piece", 1, 0.9, 0.2)


# kernels


RATE = 48_000


def noise(seed=0, n=RATE // 2):
    return np.random.default_rng(seed).normal(size=n) * 0.1


@pytest.mark.parametrize("azimuth", [-25.0, -10.0, 0.0, 5.0, 20.0])
def test_dry_pan_is_measured_exactly(azimuth):
    m = dsp.measure(*dsp.pan(noise(), azimuth), RATE)
    assert m["estimated_azimuth_deg"] == pytest.approx(azimuth, abs=1e-6) and m["ild_flatness_db"] == pytest.approx(0, abs=1e-6)
    assert m["coherence"] == pytest.approx(1) and abs(m["itd_us"]) < 1 and m["estimated_regime"] == "amplitude"


@pytest.mark.parametrize("ratio", [0.1, 0.5, 1.0])
def test_coherence_of_mixed_noise(ratio):
    common, a, b = noise(1, 10 * RATE), noise(2, 10 * RATE), noise(3, 10 * RATE)
    assert dsp.coherence(common + math.sqrt(ratio) * a, common + math.sqrt(ratio) * b, RATE) == pytest.approx(1 / (1 + ratio) ** 2, abs=0.05)


@pytest.mark.parametrize("azimuth", [-60.0, -20.0, 15.0, 45.0])
def test_binaural_delay_follows_the_head(azimuth):
    itd, _ = dsp.delay_us(*dsp.binaural(noise(), RATE, azimuth), RATE)
    assert dsp.azimuth_of_delay(itd) == pytest.approx(azimuth, abs=5)
    assert dsp.head_shadow(noise(), RATE, 0.0) == pytest.approx(noise())


def test_inverse_of_the_head_relation():
    for a in range(-90, 91, 10):
        t = math.radians(a)
        assert dsp.azimuth_of_delay(0.0875 / 343 * (t + math.sin(t)) * 1e6) == pytest.approx(a, abs=1e-3)
    assert math.isnan(dsp.azimuth_of_delay(800)) and dsp.azimuth_of_delay(700) == pytest.approx(90, abs=1e-3) and math.isnan(dsp.azimuth_of_delay(NAN))


@pytest.mark.parametrize("f", [98.0, 220.0, 440.0, 880.0])
def test_pitch(f):
    f0, voiced = dsp.pitch_track(dsp.tone(f, RATE, 0.5), RATE, 60.0, 1000.0)
    assert voiced.mean() > 0.9 and np.median(f0[voiced]) == pytest.approx(f, rel=0.01)
    with pytest.raises(dsp.Unusable):
        dsp.pitch_track(np.zeros(10), RATE, 60.0, 1000.0)


def test_processing():
    left, right = dsp.pan(noise(), 10.0)
    wide = dsp.process(left, right, RATE, [("midside", {"width": 1.2})])
    assert dsp.measure(*wide, RATE)["estimated_azimuth_deg"] == pytest.approx(math.degrees(math.atan(1.2 * math.tan(math.radians(10)))), abs=1e-6)
    late = dsp.process(left, right, RATE, [("delay_widening", {"delay_us": 300.0})])
    assert dsp.delay_us(*late, RATE)[0] == pytest.approx(round(300e-6 * RATE) / RATE * 1e6, abs=2)
    quiet = dsp.process(left, right, RATE, [("compression", {"threshold_db": -30.0, "ratio": 4.0}), ("eq", {"center_hz": 1000.0, "gain_db": 6.0, "q": 1.0})])
    assert dsp.measure(*quiet, RATE)["estimated_azimuth_deg"] == pytest.approx(10, abs=0.01)
    wet, dry = dsp.reverb(left, right, RATE, 0.3, 0.4), dsp.reverb(left, right, RATE, 0.3, 0.0)
    assert len(wet[0]) == len(dry[0]) == len(left) + round(1.2 * 0.3 * RATE) and dsp.coherence(*wet, RATE) < 0.9
    assert np.array_equal(wet[0], dsp.reverb(left, right, RATE, 0.3, 0.4)[0])
    with pytest.raises(ValueError, match="unknown"):
        dsp.process(left, right, RATE, [("warp", {})])


def test_comb_damping_is_the_one_pole():
    x, delay, g = noise(5, 500), 37, 0.8
    out, line, last = [], [0.0] * delay, 0.0
    for v in x:
        y = line.pop(0)
        last = 0.75 * y + 0.25 * last
        line.append(v + g * last)
        out.append(y)
    assert dsp._comb(x, delay, g) == pytest.approx(np.array(out), abs=1e-12)


def test_mixture_of_gated_tones():
    gate = np.repeat(np.arange(24) % 2, RATE // 12)
    a, b = dsp.pan(dsp.tone(220.0, RATE, 2.0) * gate, 20.0), dsp.pan(dsp.tone(330.0, RATE, 2.0) * (1 - gate), -15.0)
    found = dsp.mixture(a[0] + b[0], a[1] + b[1], RATE)
    assert sorted(round(x) for x, _ in found[:2]) == [-15, 20]


def test_guards(spark):
    for left, right in (([0.0] * 20, [0.0] * 20), ([1.0] * 4, [1.0] * 4), ([NAN] * 20, [1.0] * 20)):
        with pytest.raises(dsp.Unusable):
            dsp.level_cues(left, right, RATE)
    frame = spark.createDataFrame([(1, [0.0] * 20, [0.0] * 20)], "id int, left array<double>, right array<double>")
    assert K.measured(frame, ["id"], RATE).first().problem == "the signal is silent"


def test_ridge_probe_is_direct(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 4))
    y = x @ np.array([1.0, -2.0, 0.5, 3.0]) + 2 + rng.normal(size=60) * 0.1
    rows = spark.createDataFrame([(i, x[i].tolist(), float(y[i]), i % 5) for i in range(60)], "id long, x array<double>, y double, g long")
    got = {r.key: r.predicted for r in K.leave_one_group_out(rows, "id", "x", "y", "g", 0.7).collect()}
    for g in range(5):
        on = np.arange(60) % 5 != g
        xc, yc = x[on] - x[on].mean(0), y[on] - y[on].mean()
        w = np.linalg.solve(xc.T @ xc + 0.7 * np.eye(4), xc.T @ yc)
        for i in np.flatnonzero(~on):
            assert got[int(i)] == pytest.approx((x[i] - x[on].mean(0)) @ w + y[on].mean())


def test_registered_functions(spark):
    K.register(spark)
    left, right = dsp.pan(noise(), 15.0)
    spark.createDataFrame([(left.tolist(), right.tolist())], "l array<double>, r array<double>").createOrReplaceTempView("clips_for_udf")
    assert spark.sql("SELECT cue_measure(l, r).azimuth_deg AS a FROM clips_for_udf").first().a == pytest.approx(15, abs=1e-6)
    spark.createDataFrame([(dsp.tone(220.0, RATE, 0.3).tolist(),)], "m array<double>").createOrReplaceTempView("tones_for_udtf")
    assert spark.sql("SELECT f.f0 FROM tones_for_udtf, LATERAL pitch_frames(m, 80D, 800D) f WHERE f.voiced").first().f0 == pytest.approx(220, rel=0.01)


# sources and streams


def test_wav_round_trip(spark, tmp_path):
    for bits in (16, 24):
        x = noise(1, 1000)
        back, rate = wav.decode(wav.encode([x, -x], RATE, bits))
        assert rate == RATE and back == pytest.approx(np.column_stack([x, -x]), abs=2.0 ** (2 - bits))
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "AuSep_1_vc_07_Piece.wav").write_bytes(wav.encode([noise(2, 4800)], RATE))
    (tmp_path / "d" / "other.txt").write_text("x")
    row = wav.stems(spark, str(tmp_path)).first()
    assert (row.stem, row.rate, row.channels, row.frames) == ("AuSep_1_vc_07_Piece", RATE, 1, 4800)
    assert wav.discover(spark, str(tmp_path)).count() == 1
    parsed = P.parse_stems(wav.stems(spark, str(tmp_path)), "stem").first()
    assert (parsed.track, parsed.code, parsed.piece_number, parsed.piece, parsed.instrument) == (1, "vc", 7, "Piece", "cello")
    plans = spark.createDataFrame([(1, "AuSep_1_vc_07_Piece", 0.05, 0.1), (2, "AuSep_1_vc_07_Piece", 0.0, 0.02)], "id int, stem string, start_s double, duration_s double")
    parts = {r.id: r.mono for r in wav.excerpts(spark, plans, str(tmp_path), 24_000, ["id"]).collect()}
    assert len(parts[1]) == 2400 and any(parts[1][:1000]) and not any(parts[1][1300:]) and len(parts[2]) == 480
    clips = spark.createDataFrame([(1, [0.1] * 10, [0.2] * 10)], "id int, left array<double>, right array<double>")
    assert wav.decode(bytes(wav.as_wav(clips, ["id"], RATE).first().wav))[0].shape == (10, 2)


def test_records(spark, tmp_path):
    (tmp_path / "labels.jsonl").write_text('{"item_id": "a", "build_id": "x1", "answer_side": "left", "answer_azimuth_deg": 10.0, "render": {"instrument": "cello"}, "measured_evidence": {"ild_db": 1.0, "f0_hz": NaN}}\n\n{"item_id": "b", "question": {"answer_side": "right", "answer_azimuth_deg": -5.0}, "render": {"instrument": "flute"}, "measured_evidence": null}\n')
    rows = {r.item_id: r for r in records.labels(spark, str(tmp_path / "labels.jsonl")).filter("item_id IS NOT NULL").collect()}
    assert rows["a"].azimuth == 10 and rows["b"].answer_side == "right" and rows["b"].evidence is None and math.isnan(rows["a"].evidence.binaural_azimuth_deg)
    assert records.build_id(spark, str(tmp_path / "labels.jsonl")) == "x1"
    records.check_build_ids("x1", None)
    with pytest.raises(ValueError):
        records.check_build_ids("x1", "x2")
    (tmp_path / "answers.jsonl").write_text('{"item_id": "a", "answer": "first"}\n{"item_id": "b", "transcript": "told"}\n\n{"item_id": "a", "answer": "last"}\n')
    assert {r.item_id: r.answer for r in records.answers(spark, str(tmp_path / "answers.jsonl")).collect()} == {"a": "last", "b": "told"}
    (tmp_path / "bad.jsonl").write_text('{"item_id": "a", "answer": null, "transcript": "x"}\n')
    with pytest.raises(Exception, match="an answer is null"):
        records.answers(spark, str(tmp_path / "bad.jsonl")).collect()
    track = spark.createDataFrame([(0.0, 0.0), (0.01, 220.1234)], "t double, f0 double")
    records.write_f0_annotations(track, str(tmp_path / "f0"))
    assert [tuple(r) for r in records.f0_annotations(spark, str(tmp_path / "f0")).orderBy("t").collect()] == [(0.0, 0.0), (0.01, 220.123)]
    one, two = {"seed": 1, "angles_degrees": [0.0], "source_root": "x"}, {"seed": 2, "angles_degrees": [0.0], "source_root": "x"}
    assert records.fingerprint(one) != records.fingerprint(two) and records.fingerprint(one) == records.fingerprint(one | {"source_root": "y"}) and len(records.fingerprint(one)) == 12
    records.write_splits(spark.createDataFrame([("a", "train"), ("b", "test")], "id string, split string"), str(tmp_path / "splits"))
    assert (tmp_path / "splits" / "split=train").exists()
    records.write_jsonl(track, str(tmp_path / "sorted"), "t")
    assert next((tmp_path / "sorted").glob("part-*")).read_text().startswith('{"f0":')


def test_streams(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows.write.parquet(str(tmp_path / "in"))
    stream = events.read(spark, str(tmp_path / "in"))
    events.run_now(events.once(stream, "event_id"), str(tmp_path / "once"), str(tmp_path / "c1"))
    assert spark.read.parquet(str(tmp_path / "once")).count() == rows.select("event_id").distinct().count()
    events.run_now(events.counts(stream, "1 hour"), str(tmp_path / "counts"), str(tmp_path / "c2"))
    closed = spark.read.parquet(str(tmp_path / "counts"))
    want = rows.groupBy(F.window("ts", "1 hour"), "event_type").count()
    assert closed.join(want, ["window", "event_type"]).filter("n <> count").count() == 0
    assert events.sessions(stream).isStreaming
    items = grid(spark).withColumn("item_id", F.substring("item_id", 6, 3).cast("long")).withColumn("estimated_azimuth_deg", F.col("azimuth"))
    folder = str(tmp_path / "answers")
    assert events.collect_missing(items.limit(4), folder, events.offline_answerer) == 4
    assert events.collect_missing(items, folder, events.offline_answerer) == 7 and events.collect_missing(items, folder, events.offline_answerer) == 0
    arrivals = events.read(spark, folder, "item_id long, answer string", "json")
    events.run_now(events.score_arrivals(arrivals, items), str(tmp_path / "scored"), str(tmp_path / "c3"))
    assert spark.read.parquet(str(tmp_path / "scored")).filter("within").count() == 11


def test_random_baseline_draws_the_grid(spark):
    angles = [float(a) for a in range(-25, 30, 5)]
    got = S.random_baseline(grid(spark), angles, random.Random(1).randrange(100)).select("predicted").collect()
    assert all(r.predicted in angles for r in got)


def test_collection(spark):
    from aurigraph.operators import collect as C

    groups = spark.createDataFrame([(i, n) for i, n in enumerate([2, 3, 4, 5, 5, 9])], "piece int, n int")
    found = {r.piece: (r.n, r.angles) for r in C.separated_angles(groups, "piece", "n", [float(a) for a in range(-25, 30, 5)], 3).collect()}
    for n, angles in found.values():
        assert (angles is None) == (n == 9)
        assert angles is None or (len(angles) == n and all(b - a >= 10 for a, b in zip(angles, angles[1:])))
    dense = C.dense_examples(C.dense_angles(spark, 40, [0.0, 10.0], 1), ["a", "b"]).withColumn("back", T.signed_azimuth(F.col("target"))).collect()
    assert len(dense) == 40 and all(abs(r.back - r.azimuth) <= 1.1 and abs(r.azimuth) > 0.2 and r.audio_path == "ab"[r.id % 2] for r in dense)
    assert max(C.round_trip_error(a / 4) for a in range(-100, 101)) < 0.5
    got = [x for (x,) in values(spark, [("plain",), ('{"text": "t"}',), ('[{"output": "o"}]',), ('["s"]',)], "o string", C.provider_text(F.col("o")))]
    assert got == ["plain", "t", "o", "s"]
    assert values(spark, [("1, -2.5,x",)], "t string", C.number_list(F.col("t"))) == [([1.0, -2.5, None],)]
    clip = spark.createDataFrame([(1, [0.0] * 50, [1.0] * 50)], "id long, left array<double>, right array<double>")
    one, two = (C.dithered(clip, "id", 4).first() for _ in range(2))
    assert one == two and one.left != [0.0] * 50 and abs(np.mean(one.right) - 1) < 0.05
    vote = lambda l, r: C.regime_vote(l, r, RATE)["regime"]
    assert vote(*dsp.pan(noise(), 20.0)) == "amplitude" and vote(*dsp.binaural(noise(), RATE, 45.0)) == "delayed"
