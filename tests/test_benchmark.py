"""Planning, rendering, measuring, validating, reporting and publishing a benchmark, by hand-worked cases and plain loops."""

from __future__ import annotations

import json
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from aurigraph.functions import arrays as A
from aurigraph.functions import dsp
from aurigraph.functions import text as T
from aurigraph.operators import collect as C
from aurigraph.operators import joins as J
from aurigraph.operators import mixplan as X
from aurigraph.operators import plan as P
from aurigraph.operators import providers as O
from aurigraph.operators import score as S
from aurigraph.operators import signals as K
from aurigraph.operators import track as W
from aurigraph.operators import validate as L
from aurigraph.sources import records, wav

RATE = 48_000


def noise(seed=0, n=RATE // 2):
    return np.random.default_rng(seed).normal(size=n) * 0.1


# joins


def test_nearest_in_time_is_linear_and_brute_force(spark):
    rng = np.random.default_rng(1)
    frames = [(int(k), float(t), float(i)) for i, (k, t) in enumerate(zip(rng.integers(0, 3, 400), rng.integers(0, 900, 400)))]
    targets = [(int(k), float(t)) for k, t in zip(rng.integers(0, 4, 300), rng.integers(-50, 950, 300))]
    want = {}
    for k, t in targets:
        best = min(((abs(u - t), u, v) for j, u, v in frames if j == k), default=None)
        want[k, t] = best[2] if best and best[0] <= 20 else None
    f, a = spark.createDataFrame(frames, "k long, t double, f0 double"), spark.createDataFrame(targets, "k long, t double")
    for bucket in (None, 7.0, 1000.0):
        assert {(r.k, r.t): r.nearest_f0 for r in J.nearest_in_time(a, f, "k", "t", ["f0"], 20, bucket).collect()} == want
    many = spark.range(100_000).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("t"), F.col("id").cast("double").alias("f0"))
    started = time.perf_counter()
    J.nearest_in_time(many.select("k", (F.col("t") + 0.3).alias("t")), many, "k", "t", ["f0"], 1.0).write.format("noop").mode("overwrite").save()
    assert time.perf_counter() - started < 20


def test_pitch_comparison(spark):
    rows = spark.createDataFrame([(100.0, 100.0), (206.0, 200.0), (None, 300.0), (110.0, 0.0), (None, 0.0), (float("nan"), 50.0)], "f double, r double")
    got = J.compare_pitch(rows, "f", "r").first()
    assert (got.frames, got.compared, got.reference_voiced) == (6, 2, 4)
    assert (got.median_error, got.mean_error, got.within, got.voicing_agreement) == (pytest.approx(1.5), pytest.approx(1.5), 1.0, pytest.approx(0.5))


# scores


def test_repeated_answers_are_one(spark):
    items = spark.createDataFrame([("a", 10.0), ("b", -5.0)], "item_id string, azimuth double")
    answers = spark.createDataFrame([("a", "10 degrees left", 1), ("a", "10 degrees right", 2), ("b", "5 degrees right", 1)], "item_id string, answer string, attempt int")
    last = {r.item_id: r.predicted for r in S.score(items, answers, "attempt").collect()}
    assert last == {"a": -10.0, "b": -5.0} and S.score(items, answers).count() == 2
    assert S.paired(items.withColumn("stem", F.lit(1)), answers, answers).count() == 2


def test_full_report_and_its_file(spark, tmp_path):
    items = spark.createDataFrame([("a", 10.0), ("b", -5.0), ("c", 0.0)], "item_id string, azimuth double")
    evidence = spark.createDataFrame([("a", 10.0, 3.0, 0.0, 1.0, None, "amplitude")], "item_id string, estimated_azimuth_deg double, ild_db double, itd_us double, coherence double, f0_hz double, estimated_regime string")
    answers = spark.createDataFrame([("a", "It is at 10 degrees to the left."), ("b", "5 degrees to the left")], "item_id string, answer string")
    scored = S.score_verified(items, evidence, answers)
    flags = {r.item_id: (r.all_passed, r.inference_passed) for r in scored.collect()}
    assert flags == {"a": (True, True), "b": (None, None), "c": (None, None)}
    row = S.full_report(scored, "model").first()
    assert (row["items"], row.n_answered, row.all_passed_rate, row.inference_passed_rate, row.within_by_angle) == (3, 2, 1.0, 1.0, {-5.0: 0.0, 0.0: 0.0, 10.0: 1.0})
    line = S.full_report(scored, "model").select(S.summary_line()).first()[0]
    assert line.startswith("model ") and "within 5 deg 33.3%" in line and "inference 100.0%" in line
    empty = S.full_report(S.score_verified(items, evidence.limit(0), answers), "none")
    assert empty.first().inference_passed_rate is None and "inference n/a" in empty.select(S.summary_line()).first()[0]
    records.write_reports(S.full_report(scored, "model").unionByName(empty), "labels.jsonl", 3, str(tmp_path / "r"))
    read = records.report(spark, str(tmp_path / "r")).first()
    assert read.labels == "labels.jsonl" and [r.name for r in read.reports] == ["model", "none"]


def test_bootstrap_of_many_clusters_is_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    rows = [(int(c), bool(rng.random() < 0.6), bool(rng.random() < 0.4)) for c in rng.integers(0, 40, 600)]
    frame = spark.createDataFrame(rows, "c long, cue_correct boolean, audio_correct boolean")
    got = S.bootstrap_many(frame, "c", 400, 5).first()
    order = [tuple(r) for r in S._cluster_sums(frame, "c").select(F.xxhash64(F.col("c").cast("string")).alias("h"), "n", "cue", "audio").orderBy("h").collect()]
    means = []
    for k in range(400):
        n = cue = audio = 0.0
        for i in np.random.default_rng([5, k]).integers(0, len(order), len(order)):
            n, cue, audio = n + order[i][1], cue + order[i][2], audio + order[i][3]
        means.append((cue / n, audio / n))
    gaps = [a - b for a, b in means]
    assert (got.cue_low, got.cue_high) == tuple(pytest.approx(np.percentile([m[0] for m in means], q), abs=1e-5) for q in (2.5, 97.5))
    assert (got.gap_low, got.gap_high) == tuple(pytest.approx(np.percentile(gaps, q), abs=1e-5) for q in (2.5, 97.5))
    assert got == S.bootstrap_many(frame.repartition(3), "c", 400, 5).first()


def test_bootstraps_agree(spark, monkeypatch):
    """Hash draws, generator draws and Poisson draws have the same spread."""
    rng = np.random.default_rng(4)
    rows = [(int(c), bool(rng.random() < 0.5 + (c % 5) * 0.08), bool(rng.random() < 0.4)) for c in rng.integers(0, 120, 3000)]
    frame = spark.createDataFrame(rows, "c long, cue_correct boolean, audio_correct boolean")
    ends = [S.cluster_bootstrap(frame, "c", 600, 1).first(), S.bootstrap_many(frame, "c", 2000, 1).first()]
    monkeypatch.setattr(S, "BROADCAST_CLUSTERS", 10)
    ends.append(S.bootstrap_many(frame, "c", 2000, 1).first())
    for name in ("cue_low", "cue_high", "gap_low", "gap_high"):
        values = [e[name] for e in ends]
        assert max(values) - min(values) < 0.02


# plans


def test_public_ids_beyond_five_digits(spark):
    rows = spark.range(100_300).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("k"))
    ids = P.opaque_ids(rows, "k", 1, "t_")
    assert ids.select("public_id").distinct().count() == 100_300
    assert ids.filter("public_id = 't_100299'").count() == 1 and ids.filter("public_id = 't_00007'").count() == 1


def test_pages_ids_and_lists(spark):
    rows = spark.createDataFrame([(1, 10, "x"), (1, 11, "y"), (2, 20, "x"), (2, 21, "z"), (3, 30, "x"), (3, 31, "z")], "page int, k int, artist string")
    assert sorted(r.k for r in P.one_a_page(rows, "page", "k", "artist").collect()) == [10, 21]  # nothing of the third page is new
    assert sorted(r.k for r in P.first_of_each(rows, "artist", "k").collect()) == [10, 11, 21]
    assert {r.k: r.place for r in P.by_ids(rows, "k", [30, 10]).collect()} == {30: 1, 10: 2}
    with pytest.raises(KeyError):
        P.by_ids(rows, "k", [30, 99])


def test_angles_draw_on_or_raise(spark):
    assert C.pick_separated("p", 6, [float(a) for a in range(-25, 30, 5)], 1) == [-25.0, -15.0, -5.0, 5.0, 15.0, 25.0]  # one choice in many orders
    assert C.pick_separated("p", 7, [float(a) for a in range(-25, 30, 5)], 1) is None
    narrow = [x / 1000 for x in range(-25_000, 25_001, 390) if abs(x) > 200]  # leaves little beside the centre
    assert len({C.draw_clear(i, narrow, 3, 25.0) for i in range(5)}) == 5
    with pytest.raises(RuntimeError):
        C.draw_clear(1, [0.0], 1, 0.1)


def test_mixture_plans(spark):
    stems = [(1, "a", "vc", 480_000), (2, "a", "vn", 960_000), (3, "b", "fl", 480_000), (4, "c", "cl", 96_000), (5, "c", "vn", 480_000)] + [(10 + i, "d", "vn", 480_000) for i in range(6)]
    frame = spark.createDataFrame([(*s, RATE) for s in stems], "stem_id int, piece_id string, instrument_code string, frames long, sample_rate int")
    splits = spark.createDataFrame([(p, "test") for p in "abcd"], "piece_id string, split string")
    planned = X.plans(frame, splits, [float(a) for a in range(-25, 30, 5)], 6.0, 7)
    (row,) = planned.collect()
    assert (row.piece_id, row.stems, row.n, row.public_id) == ("a", ["1", "2"], 2, "mixture_test_00000") and 0 <= row.start_s <= 4
    assert row.angles[1] - row.angles[0] >= 10 and row.render_id == f"mixture_a_{round(row.start_s * 1000)}ms"
    assert {r.piece_id for r in X.skipped(frame, planned, 6.0).collect()} == {"c", "d"}  # short, and too many; b has one stem
    asked = planned.select("split", *X.question(F.col("angles"), F.col("public_id"), F.col("render_id")))
    assert X.private(asked).first().answer_azimuths_deg == sorted(row.angles, reverse=True)
    assert set(X.public(asked).columns) == {"question_id", "split", "question_type", "question"}


def test_mixtures_are_measured(spark):
    rows = spark.createDataFrame([(1, [15.0, -20.0], [dsp.tone(300.0, RATE, 0.3).tolist(), dsp.tone(1040.0, RATE, 0.3).tolist()])], "id int, planted array<double>, monos array<array<double>>")
    found = X.measured(K.mixed(rows, ["id", "planted"], "monos", "planted"), ["id", "planted"], RATE, 2)
    assert sorted(found.first().measured) == [pytest.approx(-20, abs=1), pytest.approx(15, abs=1)]


# validation


def test_one_build_or_an_error(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", None)], "item_id string, build_id string")
    assert L.of_one_build(rows).count() == 3
    with pytest.raises(Exception, match="different builds"):
        L.of_one_build(rows.unionByName(rows.withColumn("build_id", F.lit("y")))).collect()


def test_answerable_azimuth(spark):
    steps = "array<struct<kind: string, params: map<string, double>>>"
    rows = spark.createDataFrame([(10.0, [("reverb", {"wet": 0.3})], "amplitude"), (50.0, [], "binaural")], f"a double, p {steps}, r string")
    asked = P.answerable_azimuth(F.col("a"), F.col("p"), F.col("r"))
    assert rows.filter("r = 'binaural'").select(asked).first()[0] == 50.0
    with pytest.raises(Exception, match="no azimuth"):
        rows.filter("r = 'amplitude'").select(asked).collect()


# kernels


def test_measure_has_pitch_of_the_instrument(spark):
    left, right = dsp.pan(dsp.tone(294.0, RATE, 0.3), 10.0)
    rows = spark.createDataFrame([(1, left.tolist(), right.tolist(), "vn"), (2, left.tolist(), right.tolist(), "db"), (3, left.tolist(), right.tolist(), None)], "id int, left array<double>, right array<double>, code string")
    found = {r.id: r.f0_hz for r in K.measured(rows, ["id"], RATE, code="code").collect()}
    assert found[1] == pytest.approx(294, rel=0.01) and (math.isnan(found[2]) or found[2] < 250) and math.isnan(found[3])
    with pytest.raises(ValueError):
        dsp.instrument_range("kazoo")
    assert dsp.instrument_range(" VC ") == (61.74, 1046.50)


@pytest.mark.parametrize("samples", [-20, 0, 7])
def test_delays_and_reliability(samples):
    x = noise(2)
    left, right = (x, np.concatenate([np.zeros(samples), x])[: len(x)]) if samples >= 0 else (np.concatenate([np.zeros(-samples), x])[: len(x)], x)
    us, strength = dsp.delay_us(left, right, RATE)
    assert us == pytest.approx(samples / RATE * 1e6, abs=1) and dsp.reliable(strength)
    assert not dsp.reliable(dsp.delay_us(noise(3), noise(4), RATE)[1])


def test_makeup_gain_and_one_pole_limits():
    x = noise(5)
    plain, lifted = dsp.compressor(x, x, RATE, -30.0, 4.0), dsp.compressor(x, x, RATE, -30.0, 4.0, makeup_db=6.0)
    assert lifted[0] == pytest.approx(plain[0] * 10 ** (6 / 20))
    assert dsp.compressor(x, x, RATE, -30.0, 4.0, attack_s=0.0, release_s=0.0)[0].shape == x.shape
    with pytest.raises(ValueError):
        dsp.compressor(x, x, RATE, -30.0, 0.5)


@pytest.mark.parametrize("ratio", [0.0, 0.5, 2.0])
def test_decorrelated_noise(ratio):
    x = noise(6, RATE)
    made = dsp.decorrelated(x, ratio, np.random.default_rng(1))
    assert np.mean(made**2) == pytest.approx(ratio * np.mean(x**2), rel=1e-9)
    left, right = (c + dsp.decorrelated(c, ratio, np.random.default_rng(s)) for c, s in zip(dsp.pan(x, 10.0), (1, 2)))
    assert dsp.coherence(left, right, RATE) == pytest.approx(dsp.coherence_of_noise(ratio), abs=0.08)
    with pytest.raises(ValueError):
        dsp.decorrelated(x, -1.0, np.random.default_rng(1))


def test_unrelated_pairs():
    left, right = dsp.unrelated(noise(1, RATE), 0.1 * noise(2, RATE + 50))
    assert len(left) == len(right) == RATE and np.mean(left**2) == pytest.approx(np.mean(right**2)) and dsp.coherence(left, right, RATE) < 0.15
    with pytest.raises(dsp.Unusable):
        dsp.unrelated(np.zeros(10), noise())


def test_notes_and_glides_are_tracked():
    audio, times, truth = dsp.notes([220.0, 330.0], RATE, 0.4, 0.1)
    assert len(audio) == RATE and len(times) == len(truth) == 100 and set(truth) == {0.0, 220.0, 330.0} and truth[0] == truth[45] == 0.0
    f0, voiced = dsp.pitch_track(audio, RATE, 100.0, 1000.0)
    centre = (np.arange(len(f0)) * dsp.HOP_S + 2048 / dsp.PITCH_RATE / 2) / dsp.HOP_S
    sure = [(f, truth[int(c)]) for f, c, v in zip(f0, centre, voiced) if v and truth[int(c)] > 0]
    assert len(sure) > 30 and np.median([abs(f / t - 1) for f, t in sure]) < 0.01
    audio, times, truth = dsp.glide(200.0, 400.0, 0.5, RATE)
    assert len(times) == 50 and truth[25] == pytest.approx(200 * 2 ** (0.25 / 0.5)) and truth[0] == 0.0 and np.abs(audio).max() <= 0.5
    with pytest.raises(ValueError):
        dsp.notes([], RATE)
    with pytest.raises(ValueError):
        dsp.glide(0.0, 100.0, 1.0, RATE)


def test_kinds_of_processing_are_functions(spark):
    K.register(spark)
    left, right = dsp.pan(noise(1, 4096), 10.0)
    spark.createDataFrame([(left.tolist(), right.tolist())], "l array<double>, r array<double>").createOrReplaceTempView("clips_for_kinds")
    params = {"compression": "map('threshold_db', -20D, 'ratio', 4D)", "eq": "map('center_hz', 900D, 'gain_db', 3D, 'q', 1D)", "midside": "map('width', 1.2D)", "delay_widening": "map('delay_us', 250D)", "reverb": "map('rt60_s', 0.05D, 'wet', 0.2D)"}
    for kind in dsp.KINDS:
        got = spark.sql(f"SELECT cue_{kind}(l, r, {params[kind]}) AS x FROM clips_for_kinds").first().x
        values = dict(zip(params[kind][4:-1].replace("'", "").replace("D", "").split(", ")[::2], map(float, params[kind][4:-1].replace("'", "").replace("D", "").split(", ")[1::2])))
        want = dsp.process(left, right, RATE, [(kind, values)])
        assert got.left == pytest.approx(want[0]) and got.right == pytest.approx(want[1])


def test_arrays_come_as_views(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, []), (3, [None, 3.0])], "id int, x array<double>")
    got = {r.id: r.y for r in K.per_row(rows.filter("id < 3"), ["x"], ["id"], lambda x: {"y": np.asarray(x) * 2}, "y array<double>").collect()}
    assert got == {1: [2.0, 4.0], 2: []}
    assert K.per_row(rows.filter("id = 3"), ["x"], ["id"], lambda x: {"y": list(x)}, "y array<double>").first().y == [None, 3.0]


# surveys


def test_track_survey_and_its_file(spark, tmp_path):
    n = 8192
    left, right = dsp.pan(np.concatenate([noise(1, n), noise(2, n) * 1e-4, noise(3, n), noise(4, 50)]), 15.0)
    tracks = spark.createDataFrame([("t", left.tolist(), right.tolist()), ("silent", [0.0] * 3 * n, [0.0] * 3 * n)], "track string, left array<double>, right array<double>")
    loud = W.windows(tracks, RATE, n / RATE)
    assert [(r.track, r.start) for r in loud.orderBy("start").collect()] == [("t", 0), ("t", 2 * n)]
    planted = W.controls(loud, RATE, (-10.0, 20.0), {"dry": [], "width": [("midside", {"width": 1.2})]})
    assert planted.count() == 4 and planted.filter("chain = 'dry' AND error > 0.01").count() == 0
    summaries = W.summary(tracks, loud, planted, RATE)
    rows = {r.track: r for r in summaries.collect()}
    assert rows["t"].windows_measured == 2 and rows["t"].regimes == {"amplitude": 2} and rows["t"].estimated_azimuth_deg_mean == 15.0
    assert rows["silent"].windows_measured == 0 and rows["silent"].worst_control is None
    assert rows["t"].worst_by_chain["dry"] < 0.01 < rows["t"].worst_by_chain["width"]
    records.write_surveys(W.nested(summaries.filter("track = 't'"), loud, planted, RATE), str(tmp_path / "s"))
    read = json.loads(next((tmp_path / "s").glob("part-*.txt")).read_text())
    assert read["name"] == "t" and len(read["windows"]) == 2 and len(read["controls"]) == 4 and read["windows"][0]["evidence"]["estimated_regime"] == "amplitude"
    swept = W.wet_sweep(loud.filter("start = 0").select("track", A.downmix(F.col("left"), F.col("right")).alias("mono")), ["track"], RATE, (10.0,), (0.0, 0.6), 0.1)
    assert {r.wet: r.coherence > 0.9 for r in swept.collect()} == {0.0: True, 0.6: False}


# providers and texts


def test_providers(spark):
    assert {"front end", "always centre", "no answer", "audio only"} <= set(O.available())
    with pytest.raises(KeyError, match="front end"):
        O.provider("nobody")
    items = spark.createDataFrame([(1, "cello", 10.0, 2.0), (2, "flute", None, -1.0)], "item_id long, instrument string, estimated_azimuth_deg double, ild_db double")
    assert O.provider("front end")(items).count() == 1 and O.provider("no answer")(items).count() == 0
    model = O.by_batch(lambda rows: [f"{i} degrees left" for i in rows["item_id"]], ["item_id", "ild_db"])
    assert {r.item_id: r.answer for r in model(items).collect()} == {1: "1 degrees left", 2: "2 degrees left"}
    O.register("ones", model)
    with pytest.raises(ValueError):
        O.register("ones", model)


def test_outputs_modes_and_pairs(spark):
    outs = ["  plain ", '{"json_str": "", "text": "t"}', '[["deep"]]', '[{"output": "o"}, "x"]', "[]", '{"other": 1}']
    rows = spark.createDataFrame([(i, o) for i, o in enumerate(outs)], "i int, o string")
    assert [r.t for r in rows.select("i", C.provider_text(F.col("o")).alias("t")).orderBy("i").collect()] == ["plain", "t", "deep", "o", "[]", '{"other": 1}']
    with pytest.raises(Exception, match="unknown encoder"):
        rows.select(C.adapter_folder(F.lit("cues"), F.lit("odd"))).collect()
    pair = spark.createDataFrame([("level difference is -3.5 dB; azimuth = arctan(0.2 * tan 30deg) = -6.1 degrees",), ("azimuth = 3",)], "t string").select(T.answer_pair(F.col("t")).alias("p")).collect()
    assert pair[0].p == (-3.5, -6.1) and pair[1].p is None


# files


def test_mixture_labels_reports_and_annotations(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"item_id": "a", "answer_azimuths_deg": [10, -5.5]}\n\n{"item_id": "b", "question": {"answer_azimuths_deg": [0]}, "measured_evidence": {"source_azimuths_deg": [1.0], "source_energy_fractions": [1.0], "active_bins": 3}}\n')
    rows = {r.item_id: r for r in records.mixture_labels(spark, str(tmp_path / "m.jsonl")).filter("item_id IS NOT NULL").collect()}
    assert rows["a"].azimuths == [10.0, -5.5] and rows["a"].evidence is None and rows["b"].azimuths == [0.0] and rows["b"].evidence.active_bins == 3
    audio = spark.createDataFrame([("/d/AuSep_1_vn_01_X.wav",), ("/d/other.wav",), ("/d/lone.wav",)], "path string")
    files = spark.createDataFrame([("/d/F0s_1_vn_01_X.txt",), ("/d/F0s_other.txt",)], "path string")
    assert {r.path: r.annotation for r in records.with_annotation(audio, files).collect()} == {"/d/AuSep_1_vn_01_X.wav": "/d/F0s_1_vn_01_X.txt", "/d/other.wav": "/d/F0s_other.txt", "/d/lone.wav": None}


def test_last_answer_over_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.jsonl").write_text('{"item_id": "a", "answer": "1"}\n{"item_id": "b", "answer": "late", "attempt": 5}\n')
    time.sleep(0.02)
    (tmp_path / "a" / "another.jsonl").write_text('{"item_id": "a", "answer": "2"}\n{"item_id": "b", "answer": "early", "attempt": 2}\n')
    assert {r.item_id: r.answer for r in records.answers(spark, str(tmp_path / "a")).collect()} == {"a": "2", "b": "late"}


def test_configurations(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"seed": "7", "sample_rate": 48000.0, "clip_duration_seconds": 6, "angles_degrees": [0, 10], "source_root": "x"}')
    read = records.config(str(tmp_path / "c.json"))
    assert read["seed"] == 7 and isinstance(read["sample_rate"], int) and isinstance(read["clip_duration_seconds"], float) and read["rendering"] == "amplitude" and read["source_root"] == str(tmp_path / "x")
    assert L.config_errors(read) == []


def test_benchmark_files(spark, tmp_path):
    items = spark.createDataFrame([("b", "train", "left", 1.0), ("a", "train", "left", 2.0), ("c", "dev", "left", 3.0), ("d", "test", "right", 4.0)], "item_id string, split string, answer_side string, azimuth double")
    out = str(tmp_path / "bench")
    records.write_benchmark(items, spark.createDataFrame([("x", ["peak_too_high"])], "render string, failures array<string>"), out, ["item_id", "split"], ["item_id", "answer_side"])
    lines = lambda name: [json.loads(x) for p in sorted((tmp_path / "bench" / name).glob("part-*")) for x in p.read_text().splitlines()]
    assert [r["item_id"] for r in lines("train")] == ["a", "b"] and lines("test_public") == [{"item_id": "d", "split": "test"}]
    assert lines("test_private_labels") == [{"answer_side": "right", "item_id": "d"}] and lines("rejected_items")[0]["failures"] == ["peak_too_high"] and len(lines("dev")) == 1
    records.write_split_ids(items, str(tmp_path / "ids"), "item_id")
    assert next((tmp_path / "ids" / "split=train").glob("part-*")).read_text() == "a\nb\n"
    records.write_json(items.agg(F.count("*").alias("plans"), F.lit(None).cast("int").alias("skipped")), str(tmp_path / "sum"))
    assert json.loads(next((tmp_path / "sum").glob("part-*")).read_text()) == {"plans": 4, "skipped": None}
    records.write_examples(spark.createDataFrame([("a", "p.wav", "q", "t", "cues")], "item_id string, audio_path string, prompt string, target string, condition string"), str(tmp_path / "sft"))
    assert "".join(p.read_text() for p in (tmp_path / "sft").glob("part-*")).startswith('{"item_id":"a","audio_path"')
    records.write_embeddings(items, str(tmp_path / "emb"))
    assert records.read_embeddings(spark, str(tmp_path / "emb")).count() == 4


def test_audio_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        (tmp_path / "none").mkdir()
        (tmp_path / "none" / "x.txt").write_text("x")
        wav.inventory(spark, str(tmp_path / "none"))
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "AuSep_1_vc_07_P.wav").write_bytes(wav.encode([noise(1, 4800)], RATE))
    assert wav.inventory(spark, str(tmp_path / "d")).count() == 1
    (tmp_path / "d" / "AuSep_2_vn_07_P.wav").write_bytes(wav.encode([noise(1, 4800), noise(2, 4800)], RATE // 2))
    with pytest.raises(Exception, match="is not mono"):
        wav.inventory(spark, str(tmp_path / "d")).collect()
    row = wav.stereo(spark, str(tmp_path / "d"), RATE, "*vn*.wav").first()
    assert len(row.left) == len(row.right) == 9600
    with pytest.raises(Exception, match="1 channels"):
        wav.stereo(spark, str(tmp_path / "d"), RATE, "*vc*.wav").collect()
    clips = spark.createDataFrame([(1, noise(1, 100).tolist(), noise(2, 100).tolist())], "id int, left array<double>, right array<double>")
    back = wav.from_wav(wav.as_wav(clips, ["id"], RATE, 24), ["id"]).first()
    assert back.left == pytest.approx(clips.first().left, abs=1e-6)


def test_entry_survives_a_missing_package(monkeypatch):
    """Without what the corpus operators need, the other queries are still there."""
    import builtins

    import __spark_entry__ as entry

    real = builtins.__import__

    def without(name, *args, **kwargs):
        if name.startswith("corpus_pipeline") or "llm" in name:
            raise ImportError(name)
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", without)
    found = entry.queries()
    assert "score_report" in found and "pipeline" not in found and "pipeline" not in entry.oracle_sql()
