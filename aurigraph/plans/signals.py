"""Closed forms, signals as arrays, densities and surveys over derived clips, items and tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import geometry as G
from ..functions import numfmt as N
from ..operators import plan as P
from ..operators import prompts as R
from ..operators import recurrences as L
from ..operators import signals as K
from ..operators import survey as Y
from .registry import query

_D = "(tan(radians({a})) / tan(radians(30.0)))"
_T30 = "tan(radians(30.0))"


@query("rms_db", "SELECT clip_id, round(20 * log10(sqrt(sum(l * l + r * r) / (2 * count(*)))), 6) AS rms_db FROM {samples} GROUP BY clip_id")
def rms_db(v):
    return v.clips.select("clip_id", F.round(A.rms_db(F.col("left"), F.col("right")), 6).alias("rms_db"))


@query("side_to_total", "SELECT clip_id, round(10 * log10((sum((l - r) * (l - r)) / count(*)) / (sum(l * l + r * r) / (2 * count(*)))), 6) AS side_db FROM {samples} GROUP BY clip_id")
def side_to_total(v):
    return v.clips.select("clip_id", F.round(A.side_to_total_db(F.col("left"), F.col("right")), 6).alias("side_db"))


@query("peak_level", "SELECT clip_id, round(max(greatest(abs(l), abs(r))), 6) AS peak FROM {samples} GROUP BY clip_id")
def peak_level(v):
    return v.clips.select("clip_id", F.round(F.greatest(A.peak(F.col("left")), A.peak(F.col("right"))), 6).alias("peak"))


@query("pan_gains", f"SELECT item_id, round((1 + d) / 2 / sqrt((1 + d) * (1 + d) / 4 + (1 - d) * (1 - d) / 4), 6) AS gain_left, round((1 - d) / 2 / sqrt((1 + d) * (1 + d) / 4 + (1 - d) * (1 - d) / 4), 6) AS gain_right FROM (SELECT item_id, {_D.format(a='estimated_azimuth_deg')} AS d FROM {{evidence}}) x")
def pan_gains(v):
    left, right = G.pan_gains(F.col("estimated_azimuth_deg"))
    return v.evidence.select("item_id", F.round(left, 6).alias("gain_left"), F.round(right, 6).alias("gain_right"))


@query("ild_azimuth_roundtrip", f"SELECT item_id, round(20 * log10((1 + d) / (1 - d)), 6) + 0.0 AS ild_db, round(azimuth, 6) + 0.0 AS recovered FROM (SELECT item_id, estimated_azimuth_deg AS azimuth, {_D.format(a='estimated_azimuth_deg')} AS d FROM {{evidence}}) x")
def ild_azimuth_roundtrip(v):
    ild = G.ild_of_azimuth(F.col("estimated_azimuth_deg"))
    return v.evidence.withColumn("i", ild).select("item_id", (F.round("i", 6) + 0.0).alias("ild_db"), (F.round(G.azimuth_of_ild(F.col("i")), 6) + 0.0).alias("recovered"))


_W = "(0.0875 / 343.0 * 1e6 * (radians({a}) + sin(radians({a}))))"


@query("woodworth", f"SELECT item_id, round({_W.format(a='3 * estimated_azimuth_deg')}, 6) + 0.0 AS itd_us FROM {{evidence}}")
def woodworth(v):
    return v.evidence.select("item_id", (F.round(G.woodworth_us(3 * F.col("estimated_azimuth_deg")), 6) + 0.0).alias("itd_us"))


@query("inverse_woodworth", "SELECT o_orderkey AS id, CAST(o_orderkey % 181 - 90 AS DOUBLE) AS recovered FROM orders")
def inverse_woodworth(v):
    planted = (F.col("o_orderkey") % 181 - 90).cast("double")
    return v.orders.select(F.col("o_orderkey").alias("id"), (F.round(G.azimuth_of_itd(G.woodworth_us(planted)), 6) + 0.0).alias("recovered"))


@query("head_shadow", "SELECT o_orderkey AS id, round(-20 * abs(sin(radians(CAST(o_orderkey % 91 AS DOUBLE)))) * (o_orderkey % 8000) / (o_orderkey % 8000 + 1500.0), 6) + 0.0 AS gain_db FROM orders")
def head_shadow(v):
    return v.orders.select(F.col("o_orderkey").alias("id"), (F.round(G.head_shadow_db((F.col("o_orderkey") % 8000).cast("double"), (F.col("o_orderkey") % 91).cast("double")), 6) + 0.0).alias("gain_db"))


@query("midside_width", "SELECT clip_id, round(sum(abs((l + r) / 2 + 1.2 * (l - r) / 2)), 6) AS left_sum, round(sum(abs((l + r) / 2 - 1.2 * (l - r) / 2)), 6) AS right_sum FROM {samples} GROUP BY clip_id")
def midside_width(v):
    left, right = A.width(F.col("left"), F.col("right"), 1.2)
    return v.clips.select("clip_id", F.round(A.total(F.transform(left, F.abs)), 6).alias("left_sum"), F.round(A.total(F.transform(right, F.abs)), 6).alias("right_sum"))


@query("width_azimuth", f"SELECT item_id, CASE WHEN abs(1.2 * d) <= 1 THEN round(degrees(atan(1.2 * tan(radians(a)))), 6) + 0.0 END AS widened, CASE WHEN abs(3.0 * d) <= 1 THEN round(degrees(atan(3.0 * tan(radians(a)))), 6) + 0.0 END AS far FROM (SELECT item_id, estimated_azimuth_deg AS a, {_D.format(a='estimated_azimuth_deg')} AS d FROM {{evidence}}) x")
def width_azimuth(v):
    a = F.col("estimated_azimuth_deg")
    return v.evidence.select("item_id", (F.round(G.azimuth_after_width(a, F.lit(1.2)), 6) + 0.0).alias("widened"), (F.round(G.azimuth_after_width(a, F.lit(3.0)), 6) + 0.0).alias("far"))


@query("delay_widen", "SELECT clip_id, CAST(32 + clip_id % 5 AS INT) AS length, round(sum((pos + clip_id % 5) * r), 6) AS moment FROM {samples} GROUP BY clip_id")
def delay_widen(v):
    left, right = A.delay_right(F.col("left"), F.col("right"), (F.col("clip_id") % 5).cast("int"))
    moment = F.aggregate(F.transform(right, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return v.clips.select("clip_id", F.size(left).alias("length"), F.round(moment, 6).alias("moment"))


@query("fractional_delay", "WITH s AS (SELECT clip_id, pos, l, r, coalesce(lag(l) OVER (PARTITION BY clip_id ORDER BY pos), 0.0) AS lb, coalesce(lag(r) OVER (PARTITION BY clip_id ORDER BY pos), 0.0) AS rb FROM {samples}) SELECT clip_id, round(sum((0.75 * l + 0.25 * lb) * (pos + 2)), 6) AS left_moment, round(sum((0.4 * r + 0.6 * rb) * (pos + 3)), 6) AS right_moment FROM s GROUP BY clip_id")
def fractional_delay(v):
    def moment(x, delay):
        return F.aggregate(F.transform(A.fractional_delay(F.col(x), F.lit(delay)), lambda y, i: y * (i + 1)), F.lit(0.0), lambda a, y: a + y)

    return v.clips.select("clip_id", F.round(moment("left", 2.25), 6).alias("left_moment"), F.round(moment("right", 3.6), 6).alias("right_moment"))


@query("downmix", "SELECT clip_id, round(sum(((l + r) / 2) * ((l + r) / 2)), 6) AS power FROM {samples} GROUP BY clip_id")
def downmix(v):
    return v.clips.select("clip_id", F.round(A.power(A.downmix(F.col("left"), F.col("right"))), 6).alias("power"))


@query("mix_stems", "SELECT label, pos, round(sum(l), 6) AS mixed_left, round(sum(r), 6) AS mixed_right FROM {samples} GROUP BY label, pos")
def mix_stems(v):
    """By position, so that a mix of any number of stems never gathers in one row."""
    rows = v.clips.select("label", F.posexplode(F.arrays_zip("left", "right")))
    return rows.groupBy("label", (F.col("pos") + 1).alias("pos")).agg(F.round(F.sum("col.left"), 6).alias("mixed_left"), F.round(F.sum("col.right"), 6).alias("mixed_right"))


@query("mix_pairs", "SELECT clip_id, round(sum((l + r) * pos), 6) AS moment FROM {samples} GROUP BY clip_id")
def mix_pairs(v):
    moment = F.aggregate(F.transform(A.mix(F.array("left", "right")), lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return v.clips.select("clip_id", F.round(moment, 6).alias("moment"))


@query("compressor_static_curve", "SELECT item_id, rms_db, round(greatest(rms_db + 40.0, 0) * 0.75, 6) AS reduction_db FROM {evidence}")
def compressor_static_curve(v):
    return v.evidence.select("item_id", "rms_db", F.round(G.gain_reduction_db(F.col("rms_db"), -40.0, 4.0), 6).alias("reduction_db"))


@query(
    "compressor_smoothed",
    """WITH RECURSIVE lv AS (SELECT clip_id, pos, greatest(20 * log10(greatest(greatest(abs(l), abs(r)), 1e-9)) + 20.0, 0.0) * 0.75 AS target FROM {samples}),
g AS (SELECT clip_id, 0 AS pos, CAST(0.0 AS DOUBLE) AS now FROM (SELECT DISTINCT clip_id FROM lv) x UNION ALL SELECT lv.clip_id, CAST(lv.pos AS INT), CASE WHEN lv.target > g.now THEN 0.5 ELSE 0.9 END * g.now + (1 - CASE WHEN lv.target > g.now THEN 0.5 ELSE 0.9 END) * lv.target FROM g JOIN lv ON lv.clip_id = g.clip_id AND lv.pos = g.pos + 1)
SELECT clip_id, round(now, 6) AS reduction_db FROM g WHERE pos = 32""",
)
def compressor_smoothed(v):
    level = F.zip_with("left", "right", lambda a, b: 20 * F.log10(F.greatest(F.abs(a), F.abs(b), F.lit(1e-9))))
    done = L.compressor(L.cut(v.clips.select("clip_id", level.alias("level")), "clip_id", "level"), "clip_id", -20.0, 4.0, 0.5, 0.9)
    return done.select("clip_id", F.round(F.element_at("y", -1), 6).alias("reduction_db"))


_EQ = "2 * pi() * (100.0 + o_orderkey % 4000) / 48000.0"


@query("peaking_eq_coeffs", f"SELECT id, round((1 + al * a) / (1 + al / a), 6) AS b0, round(-2 * cos(w) / (1 + al / a), 6) AS b1, round((1 - al * a) / (1 + al / a), 6) AS b2, round((1 - al / a) / (1 + al / a), 6) AS a2 FROM (SELECT o_orderkey AS id, {_EQ} AS w, sin({_EQ}) / 2 AS al, pow(10.0, 6.0 / 40) AS a FROM orders) x")
def peaking_eq_coeffs(v):
    c = G.peaking_eq(48000.0, 100.0 + F.col("o_orderkey") % 4000, F.lit(6.0), F.lit(1.0))
    return v.orders.select(F.col("o_orderkey").alias("id"), *[F.round(c[k], 6).alias(k) for k in ("b0", "b1", "b2", "a2")])


@query("regime_classify", "SELECT item_id, CASE WHEN itd_us > 30 THEN 'delayed' WHEN ild_flatness_db > 2 THEN 'ambiguous' ELSE 'amplitude' END AS label, CASE WHEN itd_us > 30 AND ild_flatness_db > 2 THEN 1.0 WHEN itd_us > 30 THEN 0.75 WHEN ild_flatness_db > 2 THEN 0.5 ELSE 1.0 END AS confidence FROM {evidence}")
def regime_classify(v):
    label, confidence = G.regime(F.col("itd_us"), F.col("ild_flatness_db"))
    return v.evidence.select("item_id", label.alias("label"), confidence.alias("confidence"))


_BINS = "SELECT label AS clip, CAST(floor((20 * log10(greatest(abs(l), 1e-6) / greatest(abs(r), 1e-6)) + 30.0) * 0.5) AS BIGINT) AS bin, l * l + r * r AS w FROM {samples}"
_KERNEL = "exp(-0.5 * (b.bin - a.bin) * (b.bin - a.bin))"


def _density(v):
    s = v.clips.select("label", F.explode(F.arrays_zip("left", "right")).alias("s")).select(F.col("label").alias("clip"), (20 * F.log10(F.greatest(F.abs("s.left"), F.lit(1e-6)) / F.greatest(F.abs("s.right"), F.lit(1e-6)))).alias("ild"), (F.pow("s.left", 2) + F.pow("s.right", 2)).alias("w"))
    return Y.density(s, "clip", "ild", "w", low=-30.0, step=2.0, radius=3)


@query("ild_density", f"WITH x AS ({_BINS}), h AS (SELECT clip, bin, sum(w) AS w FROM x GROUP BY clip, bin) SELECT a.clip, a.bin, round(sum(b.w * {_KERNEL}), 6) AS density FROM h a JOIN h b ON a.clip = b.clip AND abs(a.bin - b.bin) <= 3 GROUP BY a.clip, a.bin")
def ild_density(v):
    return _density(v).select("clip", "bin", F.round("density", 6).alias("density"))


@query("density_peaks", f"WITH x AS ({_BINS}), h AS (SELECT clip, bin, sum(w) AS w FROM x GROUP BY clip, bin), d AS (SELECT a.clip, a.bin, sum(b.w * {_KERNEL}) AS density FROM h a JOIN h b ON a.clip = b.clip AND abs(a.bin - b.bin) <= 3 GROUP BY a.clip, a.bin), n AS (SELECT *, lag(density) OVER (PARTITION BY clip ORDER BY bin) AS p, lead(density) OVER (PARTITION BY clip ORDER BY bin) AS q FROM d) SELECT clip, bin, round(density, 6) AS density FROM n WHERE (p IS NULL OR density >= p) AND (q IS NULL OR density > q)")
def density_peaks(v):
    return Y.peaks(_density(v), "clip", "bin", "density").select("clip", "bin", F.round("density", 6).alias("density"))


@query("energy_fraction_topk", f"WITH x AS ({_BINS}), h AS (SELECT clip, bin, sum(w) AS w FROM x GROUP BY clip, bin), f AS (SELECT clip, bin, w / sum(w) OVER (PARTITION BY clip) AS share, row_number() OVER (PARTITION BY clip ORDER BY w DESC, bin) AS k FROM h) SELECT clip, bin, round(share, 6) AS share FROM f WHERE k <= 3 AND share >= 0.05")
def energy_fraction_topk(v):
    s = v.clips.select("label", F.explode(F.arrays_zip("left", "right")).alias("s")).select(F.col("label").alias("clip"), (20 * F.log10(F.greatest(F.abs("s.left"), F.lit(1e-6)) / F.greatest(F.abs("s.right"), F.lit(1e-6)))).alias("ild"), (F.pow("s.left", 2) + F.pow("s.right", 2)).alias("w"))
    return Y.strongest(Y.histogram(s, "clip", "ild", "w", -30.0, 2.0), "clip", 3, 0.05).select("clip", "bin", F.round("share", 6).alias("share"))


@query("loud_windows", "WITH d AS (SELECT track_id, w, 10 * log10(power) AS level FROM {windows} WHERE power > 0), m AS (SELECT *, max(level) OVER (PARTITION BY track_id) AS top FROM d) SELECT track_id, w, round(level, 6) AS level FROM m WHERE level >= top - 6.0")
def loud_windows(v):
    levels = v.windows.withColumn("level", F.when(F.col("power") > 0, 10 * F.log10("power")).otherwise(float("-inf")))
    return Y.loud(levels, "track_id", "level", -6.0).select("track_id", "w", F.round("level", 6).alias("level"))


@query("window_starts", "SELECT item_id, unnest(range(0, CAST(item_id % 50 AS BIGINT) - 7 + 1, 7)) AS start FROM {items} WHERE item_id % 50 >= 7")
def window_starts(v):
    return v.items.select("item_id", F.explode(A.window_starts((F.col("item_id") % 50).cast("int"), 7).cast("array<bigint>")).alias("start"))


@query("track_spread", "SELECT track_id, count(*) AS windows, round(avg(power), 2) AS mean, round(stddev_pop(power), 2) AS spread, round(max(power) - min(power), 2) AS span FROM {windows} GROUP BY track_id")
def track_spread(v):
    return Y.spread(v.windows, "track_id", "power")


@query("regime_counts", "SELECT stem AS track, e.estimated_regime AS regime, count(*) AS n FROM {items} i JOIN {evidence} e ON i.item_id = e.item_id GROUP BY stem, e.estimated_regime")
def regime_counts(v):
    return v.items.join(v.evidence.select("item_id", "estimated_regime"), "item_id").groupBy(F.col("stem").alias("track"), F.col("estimated_regime").alias("regime")).agg(F.count("*").alias("n"))


@query("worst_control_by_chain", "SELECT chain, round(max(abs(e.estimated_azimuth_deg * CASE chain WHEN 'dry' THEN 1.0 WHEN 'width' THEN 1.1 ELSE 0.5 END - e.azimuth)), 6) AS worst FROM {evidence} e, (SELECT unnest(['dry', 'width', 'reverb']) AS chain) c GROUP BY chain")
def worst_control_by_chain(v):
    chains = F.array(*[F.struct(F.lit(n).alias("chain"), F.lit(g).alias("g")) for n, g in (("dry", 1.0), ("width", 1.1), ("reverb", 0.5))])
    grid = v.evidence.select("azimuth", "estimated_azimuth_deg", F.inline(chains))
    return Y.worst(grid.withColumn("error", F.abs(F.col("estimated_azimuth_deg") * F.col("g") - F.col("azimuth"))), "chain", "error").select("chain", F.round("worst", 6).alias("worst"))


@query("control_rollup", "WITH e AS (SELECT stem, itd_us, coherence FROM {items} i JOIN (SELECT item_id, itd_us, coherence FROM {evidence}) x ON i.item_id = x.item_id), t AS (SELECT stem, max(itd_us) AS worst, max(coherence) - min(coherence) AS span, min(coherence) AS low FROM e GROUP BY stem) SELECT count(*) AS tracks, max(worst) AS worst, round(max(span), 6) AS span, round(min(low), 6) AS low FROM t")
def control_rollup(v):
    per = v.items.join(v.evidence.select("item_id", "itd_us", "coherence"), "item_id").groupBy("stem").agg(F.max("itd_us").alias("worst"), (F.max("coherence") - F.min("coherence")).alias("span"), F.min("coherence").alias("low"))
    return per.agg(F.count("*").alias("tracks"), F.max("worst").alias("worst"), F.round(F.max("span"), 6).alias("span"), F.round(F.min("low"), 6).alias("low"))


@query("corr_side_coherence", "SELECT round(corr(abs(ild_db), coherence), 6) AS r FROM {evidence}")
def corr_side_coherence(v):
    return v.evidence.agg(F.round(F.corr(F.abs("ild_db"), F.col("coherence")), 6).alias("r"))


_SHAPE = "CASE WHEN coherence >= 0.9 THEN 'a single compact source' WHEN coherence >= 0.4 THEN 'a partly spread image' ELSE 'a widely spread or reverberant image' END"
_FIGURES = f"""concat('Instrument: ', i.instrument, '. Inter-channel level difference: ', printf('%.1f', ild_db), ' dB, ', CASE WHEN ild_db > 0 THEN 'left' ELSE 'right' END, ' louder. Above 2 kHz: ', printf('%.1f', high_frequency_ild_db), ' dB (flatness across octave bands ', printf('%.1f', ild_flatness_db), ' dB). Inter-channel delay: ', printf('%.0f', itd_us), ' microseconds',
  CASE WHEN itd_us >= 1 THEN ', right channel later.' ELSE '.' END, ' Coherence: ', printf('%.2f', coherence), ' (', {_SHAPE}, ').')"""
_TONE = "CASE WHEN f0_hz > 0 THEN concat(' Median tracked fundamental frequency: ', printf('%.1f', f0_hz), ' Hz.') ELSE '' END"


@query("describe_cues", f"""SELECT e.item_id, concat('Instrument: ', i.instrument, '. The ', CASE WHEN ild_db > 0 THEN 'left' ELSE 'right' END, ' channel is louder. ', CASE WHEN itd_us >= 1 THEN 'The right channel arrives later.' ELSE 'Neither channel arrives earlier than the other.' END, ' The stereo image is ', {_SHAPE}, '.') AS no_numbers,
  concat({_FIGURES}, {_TONE}, ' {R.LAW}') AS evidence,
  concat({_FIGURES}, ' Measured regime: ', estimated_regime, '. Azimuth implied by those numbers: ', printf('%.1f', abs(estimated_azimuth_deg)), ' degrees ', CASE WHEN estimated_azimuth_deg > 0 THEN 'left' ELSE 'right' END, ' (positive is left).', {_TONE}) AS conclusions
  FROM {{evidence}} e JOIN {{items}} i ON e.item_id = i.item_id""")
def describe_cues(v):
    rows = v.evidence.join(v.items.select("item_id", "instrument"), "item_id")
    who, f0 = F.col("instrument"), F.col("f0_hz")
    return rows.select("item_id", R.describe_cues("no_numbers", who).alias("no_numbers"), *[R.describe_cues(level, who, f0).alias(level) for level in ("evidence", "conclusions")])


@query("number_labels", "SELECT DISTINCT azimuth, concat(CASE WHEN azimuth < 0 THEN 'neg' ELSE 'p' END, CAST(CAST(abs(azimuth) AS INT) AS VARCHAR)) AS label FROM {items}")
def number_labels(v):
    return v.items.select("azimuth", N.angle_label(F.col("azimuth")).alias("label")).distinct()


@query("cumulative_phase", "SELECT clip_id, pos, round(sum(abs(l)) OVER (PARTITION BY clip_id ORDER BY pos), 6) AS phase FROM {samples}")
def cumulative_phase(v):
    """Over the samples of each signal, a row each."""
    samples = v.clips.select("clip_id", F.posexplode("left").alias("at", "x")).select("clip_id", (F.col("at") + 1).alias("pos"), F.abs("x").alias("x"))
    return L.running_sum(samples, "clip_id", "pos", "x").select("clip_id", "pos", F.round("total", 6).alias("phase"))


@query("excerpt_loudness", "SELECT s.clip_id, round(20 * log10(sqrt(avg(l * l))), 6) AS rms_db FROM {samples} s WHERE pos > clip_id % 20 AND pos <= clip_id % 20 + 8 GROUP BY s.clip_id")
def excerpt_loudness(v):
    return v.clips.select("clip_id", F.round(A.excerpt_rms_db(F.col("left"), (F.col("clip_id") % 20).cast("int"), 8), 6).alias("rms_db"))


_TRIED = """WITH tries AS (SELECT clip_id, k, (clip_id * 7 + k * 5) % 25 AS start FROM (SELECT vec_id AS clip_id FROM {embeddings}) c, (SELECT unnest(range(0, 4)) AS k) q),
levels AS (SELECT t.clip_id, t.k, t.start, 20 * log10(sqrt(avg(l * l))) AS rms_db FROM tries t JOIN {samples} s ON s.clip_id = t.clip_id AND s.pos > t.start AND s.pos <= t.start + 8 GROUP BY t.clip_id, t.k, t.start)
"""


@query("loud_excerpts", _TRIED + "SELECT clip_id, coalesce(min(CASE WHEN rms_db >= -18.5 THEN k END), 3) AS attempt FROM levels GROUP BY clip_id")
def loud_excerpts(v):
    """The first of four drawn excerpts that is loud enough, else the last, by their own levels."""
    loud = lambda k: A.excerpt_rms_db(F.col("left"), ((F.col("clip_id") * 7 + k * 5) % 25).cast("int"), 8) >= -18.5
    return P.first_loud(v.clips, 4, loud).select("clip_id", "attempt")


@query("pooled_difference", "SELECT label, pos, round(avg(l) - avg(r), 6) AS difference FROM {samples} GROUP BY label, pos")
def pooled_difference(v):
    return K.pooled_difference(v.clips, "label", "left", "right").select("label", (F.col("pos") + 1).alias("pos"), F.round("difference", 6).alias("difference"))


@query("worst_deviation", "WITH d AS (SELECT abs(ild_db / 40 - (ild_db / 40 + (item_id % 5) * 0.004)) AS d FROM {evidence}) SELECT round(max(d), 6) AS worst, max(d) < 0.02 AS survives FROM d")
def worst_deviation(v):
    rows = v.evidence.select(G.log_mel_offset(F.col("ild_db")).alias("predicted"), (F.col("ild_db") / 40 + (F.col("item_id") % 5) * 0.004).alias("measured"))
    return Y.worst_deviation(rows, "predicted", "measured").select(F.round("worst", 6).alias("worst"), "survives")


@query("first_windows", "SELECT track_id, w FROM (SELECT track_id, w, row_number() OVER (PARTITION BY track_id ORDER BY w) AS k FROM {windows}) x WHERE k <= 2")
def first_windows(v):
    return Y.first_windows(v.windows, "track_id", "w", 2).select("track_id", "w")
