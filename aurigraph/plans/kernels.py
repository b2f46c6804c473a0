"""Queries that run the signal kernels over all clips of the embeddings table, each with something planted that SQL knows.

A clip's mono signal is its vector, repeated, or noise or a tone made from its number. What is recovered is told as the planted value
that it is nearest to, or as the figure itself where that is exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import mixplan as X
from ..operators import signals as K
from ..operators import track as W
from .passes import ridge_sql
from .registry import query

RATE = 48_000
SAMPLES = 8192
_AZIMUTH = "CAST((vec_id % 11) * 5 - 25 AS DOUBLE)"
_CODES = ("vn", "va", "cl", "tpt")


def _mono(v):
    """(clip_id, azimuth, mono): 8,192 samples, the vector 128 times."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    return K.spread(v.embeddings).select(F.col("vec_id").alias("clip_id"), F.expr(_AZIMUTH).alias("azimuth"), F.flatten(F.array_repeat(e, 128)).alias("mono"))


def _noise(v, *more: Column):
    """(clip_id, azimuth, mono, ...): noise of the clip's own number."""
    rows = K.spread(v.embeddings).select(F.col("vec_id").alias("clip_id"), F.expr(_AZIMUTH).alias("azimuth"), *more)
    return K.noises(rows, rows.columns, SAMPLES, "clip_id")


def _nearest(value: str, planted: list[float]) -> Column:
    """The planted value that a figure is nearest to."""
    return F.array_min(F.array(*[F.struct(F.abs(F.col(value) - p).alias("d"), F.lit(float(p)).alias("p")) for p in planted]))["p"]


def _steps(*chain: tuple[str, dict]) -> Column:
    kind = "array<struct<kind: string, params: map<string, double>>>"
    return F.array(*[F.struct(F.lit(k).alias("kind"), F.create_map(*[x if isinstance(x, Column) else F.lit(x) for p in q.items() for x in p]).cast("map<string,double>").alias("params")) for k, q in chain]).cast(kind)


@query("stft_level_cues", f"SELECT vec_id AS clip_id, {_AZIMUTH} AS azimuth, round(20 * log10((1 + tan(radians({_AZIMUTH})) / tan(radians(30.0))) / (1 - tan(radians({_AZIMUTH})) / tan(radians(30.0)))), 4) + 0.0 AS ild_db, 0.0 AS flatness FROM embeddings")
def stft_level_cues(v):
    done = K.measured(K.rendered(_mono(v), ["clip_id", "azimuth"], RATE, "amplitude"), ["clip_id", "azimuth"], RATE)
    return done.select("clip_id", (F.round("estimated_azimuth_deg", 4) + 0.0).alias("azimuth"), (F.round("ild_db", 4) + 0.0).alias("ild_db"), F.abs(F.round("ild_flatness_db", 4)).alias("flatness"))


@query("measure_renders", f"""SELECT vec_id AS clip_id, {_AZIMUTH} AS azimuth, CAST(vec_id % 5 * 125 AS DOUBLE) AS itd_us, CASE WHEN vec_id % 5 = 0 THEN 'amplitude' ELSE 'delayed' END AS regime, true AS coherent,
  CASE WHEN vec_id % 3 = 0 THEN NULL ELSE CAST(220 + vec_id % 7 * 40 AS DOUBLE) END AS f0_hz FROM embeddings""")
def measure_renders(v):
    """Whole measurements, pitch and all: tones and noises panned, the right channel delayed by 0 to 500 microseconds."""
    code = F.element_at(F.array(*map(F.lit, _CODES)), (F.col("clip_id") % 4 + 1).cast("int"))
    f = F.when(F.col("clip_id") % 3 != 0, (220.0 + F.col("clip_id") % 7 * 40).cast("double"))
    rows = K.spread(v.embeddings).select(F.col("vec_id").alias("clip_id"), F.expr(_AZIMUTH).alias("azimuth")).withColumns({"f": f, "code": code})
    panned = K.rendered(K.noisy_tones(rows, ["clip_id", "azimuth", "code"], RATE, 0.25, "f", "clip_id"), ["clip_id", "code"], RATE, "amplitude")
    late = panned.withColumn("processing", _steps(("delay_widening", {"delay_us": (F.col("clip_id") % 5 * 125).cast("double")})))
    done = K.measured(K.processed(late, ["clip_id", "code"], RATE), ["clip_id"], RATE, code="code")
    return done.select("clip_id", (F.round("estimated_azimuth_deg") + 0.0).alias("azimuth"), (F.round("itd_us") + 0.0).alias("itd_us"), F.col("estimated_regime").alias("regime"), (F.col("coherence") >= 0.9).alias("coherent"), F.when(~F.isnan("f0_hz"), F.round(F.col("f0_hz") / 20) * 20).alias("f0_hz"))


@query("coherence_of_noise", f"SELECT vec_id AS clip_id, {_AZIMUTH} AS azimuth, round(CASE vec_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 / 2.25 ELSE 1.0 / 9 END, 6) AS coherence FROM embeddings")
def coherence_of_noise(v):
    """Each channel with noise of its own, of none, half or twice its power: the coherence falls as the closed form says."""
    rows = _noise(v, F.element_at(F.array(F.lit(0.0), F.lit(0.5), F.lit(2.0)), (F.col("vec_id") % 3 + 1).cast("int")).alias("ratio"))
    seen = K.measured(K.noisy(rows, ["clip_id", "azimuth"], "azimuth", "ratio", "clip_id"), ["clip_id", "azimuth"], RATE)
    return seen.select("clip_id", "azimuth", F.round(_nearest("coherence", [(1 + r) ** -2 for r in (0.0, 0.5, 2.0)]), 6).alias("coherence"))


@query("pitch_track", "SELECT vec_id AS clip_id, CASE WHEN vec_id % 6 <> 0 THEN CAST(150 + vec_id % 30 * 10 AS DOUBLE) END AS f0_hz, vec_id % 6 <> 0 AS voiced FROM embeddings")
def pitch_track(v):
    """A quarter of a second of six harmonics, or of noise, which has no pitch; to the nearest 5 Hz."""
    rows = K.spread(v.embeddings).select(F.col("vec_id").alias("clip_id"), (150.0 + F.col("vec_id") % 30 * 10).cast("double").alias("f"))
    noise = K.noises(rows.filter("clip_id % 6 = 0"), ["clip_id"], 12_000, "clip_id")
    clips = K.tones(rows.filter("clip_id % 6 <> 0"), ["clip_id"], RATE, 0.25, "f").unionByName(noise)
    found = K.pitches(clips, ["clip_id"], RATE, 80.0, 1000.0)
    voiced = F.col("voiced_share") > 0.9
    return found.select("clip_id", F.when(voiced, F.round(F.col("f0_hz") / 5) * 5).alias("f0_hz"), voiced.alias("voiced"))


@query("mix_pitch", "SELECT vec_id AS clip_id, CAST(100 + vec_id % 20 * 20 AS DOUBLE) AS f0_hz FROM embeddings")
def mix_pitch(v):
    """The pitch of a mix of one panned tone and weak noise, over the range of mixes."""
    rows = K.spread(v.embeddings).select(F.col("vec_id").alias("clip_id"), F.expr(_AZIMUTH).alias("azimuth"), (100.0 + F.col("vec_id") % 20 * 20).cast("double").alias("f"))
    panned = K.rendered(K.tones(rows, ["clip_id", "azimuth"], RATE, 0.4, "f"), ["clip_id"], RATE, "amplitude")
    return K.mix_pitches(panned, ["clip_id"], RATE).select("clip_id", (F.round(F.col("f0_hz") / 10) * 10).alias("f0_hz"))


_HEAD = "abs(0.0875 / 343.0 * 1e6 * (radians({a}) + sin(radians({a}))))"


@query("binaural_render", f"SELECT vec_id AS clip_id, 2.4 * {_AZIMUTH} AS azimuth, CASE WHEN {_HEAD.format(a=f'2.4 * {_AZIMUTH}')} > 30 THEN 'delayed' ELSE 'amplitude' END AS regime FROM embeddings")
def binaural_render(v):
    """Clips placed at up to 60 degrees: their azimuth comes back from the delay alone."""
    placed = _noise(v).withColumn("azimuth", F.col("azimuth") * 2.4)
    done = K.measured(K.rendered(placed, ["clip_id"], RATE, "binaural"), ["clip_id"], RATE)
    return done.select("clip_id", (F.round(F.col("binaural_azimuth_deg") / 12) * 12 + 0.0).alias("azimuth"), F.when(F.col("estimated_regime") == "delayed", "delayed").otherwise("amplitude").alias("regime"))


@query("processed_chain", f"SELECT vec_id AS clip_id, round(degrees(atan(1.1 * tan(radians({_AZIMUTH})))), 1) + 0.0 AS azimuth_deg, 250.0 AS itd_us FROM embeddings")
def processed_chain(v):
    """Compression and equalisation move no source, width does, a delay shows as one."""
    steps = _steps(("compression", {"threshold_db": -20.0, "ratio": 4.0, "makeup_gain_db": 3.0}), ("eq", {"center_hz": 1000.0, "gain_db": 6.0, "q": 1.0}), ("midside", {"width": 1.1}), ("delay_widening", {"delay_us": 250.0}))
    panned = K.rendered(_noise(v), ["clip_id"], RATE, "amplitude").withColumn("processing", steps)
    done = K.measured(K.processed(panned, ["clip_id"], RATE), ["clip_id"], RATE)
    found = [round(math.degrees(math.atan(1.1 * math.tan(math.radians(5 * i - 25)))), 1) for i in range(11)]
    return done.select("clip_id", (_nearest("estimated_azimuth_deg", found) + 0.0).alias("azimuth_deg"), (F.round("itd_us") + 0.0).alias("itd_us"))


@query("reverb", "SELECT vec_id AS clip_id, CAST(8192 + 1152 * (1 + vec_id % 4) AS INT) AS samples, vec_id % 3 = 0 AS dry FROM embeddings")
def reverb(v):
    """Clips grow by a tail of 1.2 times the reverberation time, and stay as they are where none of it is let in."""
    wet = F.when(F.col("clip_id") % 3 == 0, 0.0).otherwise(0.3)
    steps = _steps(("reverb", {"rt60_s": (0.02 * (1 + F.col("clip_id") % 4)).cast("double"), "wet": wet}))
    panned = K.rendered(_mono(v), ["clip_id"], RATE, "amplitude").withColumns({"processing": steps, "before": F.col("left")})
    done = K.processed(panned, ["clip_id", "before"], RATE)  # what was goes along: a join would move whole signals
    same = F.forall(F.zip_with(F.slice("left", 1, SAMPLES), "before", lambda a, b: F.abs(a - b) < 1e-12), lambda x: x)
    return done.select("clip_id", F.size("left").alias("samples"), same.alias("dry"))


@query("mixture_sources", "SELECT vec_id AS clip_id, CAST(vec_id % 3 * 5 + 10 AS DOUBLE) AS first_azimuth, CAST(-5 - vec_id % 4 * 5 AS DOUBLE) AS second_azimuth, '' AS failures FROM embeddings")
def mixture_sources(v):
    """Mixes of two tones at planted azimuths: rendered, measured and validated."""
    rows = K.spread(v.embeddings).select(F.col("vec_id").alias("clip_id"), F.array((F.col("vec_id") % 3 * 5 + 10).cast("double"), (-5 - F.col("vec_id") % 4 * 5).cast("double")).alias("planted"), F.lit(300.0).alias("f"), F.lit(1040.0).alias("g"))
    one = K.tones(rows, ["clip_id", "planted", "g"], RATE, 0.25).withColumnRenamed("mono", "low")
    both = K.tones(one, ["clip_id", "planted", "low"], RATE, 0.25, "g").select("clip_id", "planted", F.array("low", "mono").alias("monos"))
    mixes = K.mixed(both, ["clip_id", "planted"], "monos", "planted")
    seen = X.checked(X.measured(mixes, ["clip_id", "planted"], RATE, 2).withColumn("peak", F.lit(0.5)).withColumn("rms_db", F.lit(-20.0)), tolerance=2.0)
    ordered = F.sort_array("measured", asc=False)
    return seen.select("clip_id", (F.round(ordered[0]) + 0.0).alias("first_azimuth"), (F.round(ordered[1]) + 0.0).alias("second_azimuth"), F.array_join("failures", ",").alias("failures"))


def _tracks(v):
    """(track, left, right), one a label: noise, a loud window, a quiet one and one that is half as loud, panned, and a rest."""
    rows = v.embeddings.groupBy("label").agg(F.count("*").alias("vectors")).select(F.col("label").cast("long").alias("track"), ((F.col("label") % 11) * 5 - 25).cast("double").alias("azimuth"))
    base = K.rendered(K.noises(rows, ["track", "azimuth"], SAMPLES, "track"), ["track"], RATE, "amplitude")

    def scaled(c: str, gain: float) -> Column:
        return F.transform(c, lambda x: x * gain)

    return base.select("track", *[F.concat(scaled(c, 1.0), scaled(c, 0.0001), scaled(c, 0.5), F.slice(c, 1, 100)).alias(c) for c in ("left", "right")])


@query("track_survey", "SELECT CAST(label AS BIGINT) AS track, CAST(2 AS BIGINT) AS windows_measured, CAST((label % 11) * 5 - 25 AS DOUBLE) AS azimuth, 0.0 AS azimuth_std, 0.0 AS dry_error, 1 AS regimes FROM embeddings GROUP BY label")
def track_survey(v):
    """Whole surveys: the quiet window and the rest are left out, and a dry control comes back where it was planted."""
    tracks, window = _tracks(v), SAMPLES / RATE
    loud = W.windows(tracks, RATE, window)
    planted = W.controls(loud, RATE, angles=(-10.0, 15.0), chains={"dry": [], "width": [("midside", {"width": 1.1})]})
    found = W.summary(tracks, loud, planted, RATE)
    return found.select("track", "windows_measured", (F.round("estimated_azimuth_deg_mean", 0) + 0.0).alias("azimuth"), (F.round("estimated_azimuth_deg_std", 1) + 0.0).alias("azimuth_std"), (F.round(F.element_at("worst_by_chain", "dry"), 3) + 0.0).alias("dry_error"), F.size("regimes").alias("regimes"))


@query("wet_sweep", "SELECT vec_id AS clip_id, a.a AS azimuth, w.w AS wet, w.w > 0 AS blurred FROM (SELECT vec_id FROM embeddings) e, (SELECT CAST(unnest([-20, 10]) AS DOUBLE) AS a) a, (SELECT unnest([0.0::DOUBLE, 0.5::DOUBLE]) AS w) w")
def wet_sweep(v):
    """A wetter reverb makes channels less coherent; a dry one leaves them alike."""
    some = K.noises(K.spread(v.embeddings).select(F.col("vec_id").alias("clip_id")), ["clip_id"], SAMPLES, "clip_id")
    found = W.wet_sweep(some, ["clip_id"], RATE, (-20.0, 10.0), (0.0, 0.5), 0.1, ("coherence",))
    return found.select("clip_id", "azimuth", "wet", (F.col("coherence") < 0.9).alias("blurred"))


@query("ridge_probe", ridge_sql(10, "embedding::DOUBLE[]", 65) + "SELECT round(avg(abs(predicted - y)), 6) AS mae, round(1 - sum((predicted - y) * (predicted - y)) / (var_pop(y) * count(*)), 6) AS r2, round(avg((abs(predicted - y) <= 5)::INT), 6) AS within_5 FROM p")
def ridge_probe(v):
    rows = v.embeddings.withColumn("part", F.col("vec_id") % 10)
    return K.fit_quality(K.leave_one_group_out(rows, "vec_id", "embedding", "label", "part", 1.0)).select(*[F.round(c, 6).alias(c) for c in ("mae", "r2", "within_5")])
