"""Joins by nearness, generalization audits, mixtures, training examples and event windows."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import generalize as Z
from ..operators import joins as J
from ..operators import mixture as M
from ..operators import prompts as R
from ..operators import score as S
from .registry import query

GRID = [float(a) for a in range(-25, 30, 5)]
TRAINED = sorted({round(x, 4) + 0.0 for x in GRID} | {round(math.degrees(math.atan(1.2 * math.tan(math.radians(a)))), 4) + 0.0 for a in GRID})
_TRAINED_SQL = "SELECT CAST(x AS DOUBLE) AS angle FROM (SELECT unnest([" + ", ".join(map(repr, TRAINED)) + "]) AS x) u"


@query(
    "nearest_frame_join",
    """WITH p AS (SELECT r.event_id, r.t, f.t AS ft, f.f0, abs(f.t - r.t) AS d FROM {reference} r LEFT JOIN {frames} f ON f.user_id = r.user_id),
k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY d, ft, f0) AS n FROM p)
SELECT event_id, CASE WHEN d <= 43200 THEN f0 END AS nearest_f0 FROM k WHERE n = 1""",
)
def nearest_frame_join(v):
    return J.nearest_in_time(v.reference, v.frames, "user_id", "t", ["f0"], 43200).select("event_id", "nearest_f0")


_MATCHED = """WITH p AS (SELECT r.event_id, r.f0 AS true_f0, f.t AS ft, f.f0, abs(f.t - r.t) AS d FROM {reference} r LEFT JOIN {frames} f ON f.user_id = r.user_id),
k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY d, ft, f0) AS n FROM p), m AS (SELECT event_id, true_f0, CASE WHEN d <= 43200 THEN f0 END AS f0 FROM k WHERE n = 1)
"""


_OFF = "abs(f0 - true_f0) / true_f0"


@query("pitch_compare", _MATCHED + f"SELECT count(*) AS frames, count(*) FILTER (WHERE true_f0 > 0 AND f0 IS NOT NULL) AS compared, count(*) FILTER (WHERE true_f0 > 0) AS reference_voiced, round(median({_OFF} * 100) FILTER (WHERE true_f0 > 0), 6) AS median_error, round(avg({_OFF} * 100) FILTER (WHERE true_f0 > 0), 6) AS mean_error, round(avg(CASE WHEN f0 IS NULL OR true_f0 = 0 THEN NULL WHEN {_OFF} <= 0.03 THEN 1.0 ELSE 0.0 END), 6) AS within, round(avg(CASE WHEN (true_f0 > 0) = (f0 IS NOT NULL) THEN 1.0 ELSE 0.0 END), 6) AS voicing_agreement FROM m")
def pitch_compare(v):
    m = J.nearest_in_time(v.reference.withColumnRenamed("f0", "true_f0"), v.frames, "user_id", "t", ["f0"], 43200)
    return J.compare_pitch(m, "nearest_f0", "true_f0").select("frames", "compared", "reference_voiced", *[F.round(c, 6).alias(c) for c in ("median_error", "mean_error", "within", "voicing_agreement")])


@query("snap_to_grid", f"WITH t AS ({_TRAINED_SQL}), p AS (SELECT item_id, estimated_azimuth_deg AS a, angle, row_number() OVER (PARTITION BY item_id ORDER BY abs(estimated_azimuth_deg - angle), angle) AS n FROM {{evidence}}, t) SELECT item_id, angle AS snapped FROM p WHERE n = 1")
def snap_to_grid(v):
    return J.nearest_value(v.evidence, "estimated_azimuth_deg", TRAINED).select("item_id", "snapped")


@query("on_grid_rate", f"WITH t AS ({_TRAINED_SQL}) SELECT round(avg(CASE WHEN EXISTS (SELECT 1 FROM t WHERE abs(t.angle - e.estimated_azimuth_deg) <= 0.75) THEN 1.0 ELSE 0.0 END), 6) AS rate FROM {{evidence}} e")
def on_grid_rate(v):
    return v.evidence.agg(F.round(F.avg(J.within(F.col("estimated_azimuth_deg"), TRAINED, Z.ON_GRID_DEG).cast("double")), 6).alias("rate"))


@query("band_join", "WITH b AS (SELECT n_nationkey AS band, n_nationkey * 400.0 - 1000 AS low, n_nationkey * 400.0 - 500 AS high FROM nation) SELECT c_custkey, band FROM customer JOIN b ON c_acctbal >= low AND c_acctbal <= high")
def band_join(v):
    bands = v.nation.select(F.col("n_nationkey").alias("band"), (F.col("n_nationkey") * 400.0 - 1000).alias("low"), (F.col("n_nationkey") * 400.0 - 500).alias("high"))
    return J.in_ranges(v.customer, bands, "c_acctbal", "low", "high", 250.0).select("c_custkey", "band")


def _grid(v):
    return v.items.select("azimuth").distinct()


_ANSWERS = "WITH t AS (SELECT azimuth AS angle FROM {items} UNION SELECT round(degrees(atan(1.2 * tan(radians(azimuth)))), 4) + 0.0 FROM {items})"


@query("distinct_answers", _ANSWERS + " SELECT count(*) AS answers FROM t")
def distinct_answers(v):
    return Z.trained_answers(_grid(v), "azimuth").agg(F.count("*").alias("answers"))


@query("trained_answers", _ANSWERS + " SELECT angle FROM t")
def trained_answers(v):
    return Z.trained_answers(_grid(v), "azimuth")


@query("widest_gap", _ANSWERS + ", g AS (SELECT lead(angle) OVER (ORDER BY angle) - angle AS gap FROM t) SELECT round(max(gap), 6) AS gap FROM g")
def widest_gap(v):
    return Z.widest_gap(Z.trained_answers(_grid(v), "azimuth")).select(F.round("gap", 6).alias("gap"))


@query("choose_eval_angles", _ANSWERS + ", n AS (SELECT angle AS low, lead(angle) OVER (ORDER BY angle) AS high FROM t WHERE abs(angle) <= 25), r AS (SELECT (low + high) / 2 AS c, row_number() OVER (ORDER BY (high - low) / 2 DESC, (low + high) / 2) AS k FROM n WHERE high IS NOT NULL AND (low + high) / 2 > 0), b AS (SELECT -round(c, 1) AS angle FROM r WHERE k <= 5 UNION ALL SELECT round(c, 1) FROM r WHERE k <= 5) SELECT angle FROM b")
def choose_eval_angles(v):
    return Z.eval_angles(Z.trained_answers(_grid(v), "azimuth"), 10)


@query("discriminability", f"""WITH t AS ({_TRAINED_SQL}), a AS (SELECT DISTINCT estimated_azimuth_deg AS angle FROM {{evidence}}), p AS (SELECT a.angle, t.angle AS c, row_number() OVER (PARTITION BY a.angle ORDER BY abs(t.angle - a.angle), t.angle) AS n FROM a, t),
s AS (SELECT angle, c, abs(c - angle) AS e, CASE WHEN EXISTS (SELECT 1 FROM t WHERE abs(t.angle - p.angle) <= 0.75) THEN 1.0 ELSE 0.0 END AS own FROM p WHERE n = 1)
SELECT round(avg(CASE WHEN e <= 5 THEN 1.0 ELSE 0.0 END), 6) AS memorised_within, round(avg(e), 6) AS memorised_mae, 1.0 AS memorised_on_grid, round(avg(own), 6) AS computed_on_grid, abs(avg(CASE WHEN e <= 5 THEN 1.0 ELSE 0.0 END) - 1) > 0.05 AS separates_on_tolerance, avg(e) > 1.0 AS separates_on_error, abs(1 - avg(own)) > 0.5 AS separates_on_grid_rate FROM s""")
def discriminability(v):
    d = Z.discriminability(v.evidence.select(F.col("estimated_azimuth_deg").alias("angle")).distinct(), TRAINED)
    return d.select(*[F.round(c, 6).alias(c) for c in d.columns[:4]], *d.columns[4:])


@query("lint_warnings", _ANSWERS + ", g AS (SELECT lead(angle) OVER (ORDER BY angle) - angle AS gap FROM t) SELECT (SELECT count(*) FROM t) AS answers, round(max(gap), 6) AS gap, concat_ws(',', CASE WHEN max(gap) <= 5 THEN 'gap_within_tolerance' END, CASE WHEN (SELECT count(*) FROM t) < 32 THEN 'few_distinct_answers' END) AS warnings FROM g")
def lint_warnings(v):
    return Z.lint(Z.trained_answers(_grid(v), "azimuth")).select("answers", F.round("gap", 6).alias("gap"), "warnings")


@query("cue_answer_pairs", "SELECT CAST(floor(ild_db * 10) AS BIGINT) AS cue, CAST(azimuth AS BIGINT) AS answer, count(*) AS n FROM {evidence} GROUP BY 1, 2")
def cue_answer_pairs(v):
    pairs = v.evidence.select(F.floor(F.col("ild_db") * 10).alias("cue"), F.col("azimuth").cast("bigint").alias("answer"))
    return pairs.groupBy("cue", "answer").agg(F.count("*").alias("n"))


_ILD = "round_even(20 * log10((1 + d) / (1 - d)), 1) + 0.0"
_R = "pow(10.0, ild / 20)"
_FOUND = f"degrees(atan(({_R} - 1) / ({_R} + 1) * tan(radians(30.0))))"


@query("training_examples", f"""WITH i AS (SELECT item_id, azimuth, instrument, tan(radians(azimuth)) / tan(radians(30.0)) AS d FROM {{items}}), e AS (SELECT *, {_ILD} AS ild, 200.0 + item_id % 90 AS f0 FROM i),
p AS (SELECT *, {_FOUND} + 0.0 AS found, concat('Where is the ', instrument, ' positioned in the stereo image? Return its side and azimuth in degrees.') AS question FROM e)
SELECT item_id, 'audio_only' AS condition, concat('{R.PREAMBLE}', chr(10), '{R.STEREO_QUESTION}') AS prompt, CASE WHEN azimuth > 0 THEN concat('The ', instrument, ' is at ', printf('%.1f', azimuth), ' degrees to the left.') WHEN azimuth < 0 THEN concat('The ', instrument, ' is at ', printf('%.1f', -azimuth), ' degrees to the right.') ELSE concat('The ', instrument, ' is centred, at 0 degrees.') END AS target FROM p
UNION ALL SELECT item_id, 'cues', concat('Instrument: ', instrument, '. Inter-channel level difference: ', printf('%.1f', ild), ' dB, ', CASE WHEN ild > 0 THEN 'left' ELSE 'right' END, ' louder. Above 2 kHz: ', printf('%.1f', ild), ' dB (flatness across octave bands 0.0 dB). Inter-channel delay: 0 microseconds. Coherence: 1.00 (a single compact source). Median tracked fundamental frequency: ', printf('%.1f', f0), ' Hz. {R.LAW}', chr(10), question),
  concat('The inter-channel level difference is ', printf('%.1f', ild), ' dB, so the ', CASE WHEN ild > 0 THEN 'left' ELSE 'right' END, ' channel is louder. Converting with the panning law: r = 10^(', printf('%.1f', ild), '/20) = ', printf('%.3f', {_R}), '; d = (r - 1)/(r + 1) = ', printf('%.3f', ({_R} - 1) / ({_R} + 1) + 0.0), '; azimuth = arctan(d * tan 30deg) = ', printf('%.1f', found), ' degrees. The ', instrument, ' is at ', printf('%.1f', abs(found)), ' degrees to the ', CASE WHEN found > 0 THEN 'left' WHEN found < 0 THEN 'right' ELSE 'center' END, '.') FROM p""")
def training_examples(v):
    """Both conditions of every item, from the cues that its azimuth has."""
    ild = F.bround(G.ild_of_azimuth(F.col("azimuth")), 1) + 0.0
    cues = {"ild_db": ild, "high_frequency_ild_db": ild, "ild_flatness_db": F.lit(0.0), "itd_us": F.lit(0.0), "coherence": F.lit(1.0), "f0_hz": (200.0 + F.col("item_id") % 90).cast("double"), "audio_path": F.lit("a.wav"), "question": R.position_question(F.col("instrument"))}
    return R.training_examples(v.items.withColumns(cues)).select("item_id", "condition", "prompt", "target")


def _mix(v):
    return v.mix_items.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "azimuth"))), lambda x: x["azimuth"]).alias("azimuths"))


#: Greedy matching of up to five true values with the same shifted by 3 degrees, item ids divisible by 3 giving one fewer.
_MIX = """WITH RECURSIVE t AS (SELECT item_id, list(azimuth ORDER BY n) AS a FROM {mix_items} GROUP BY item_id),
p AS (SELECT item_id, a, list_transform(CASE WHEN item_id % 3 = 0 THEN a[1:len(a) - 1] ELSE a END, lambda x: x + 3.0) AS said FROM t),
g AS (SELECT item_id, a, said, 0 AS i, 0 AS hit, said AS rest FROM p UNION ALL
  SELECT item_id, a, said, i + 1, hit + CASE WHEN q > 0 THEN 1 ELSE 0 END, CASE WHEN q > 0 THEN list_concat(rest[1:q - 1], rest[q + 1:len(rest)]) ELSE rest END
  FROM (SELECT *, coalesce(list_position(list_transform(rest, lambda x: abs(x - a[i + 1]) <= 5.0), true), 0) AS q FROM g WHERE i < len(a)) s),
done AS (SELECT item_id, a, said, hit FROM g WHERE i = len(a))
"""


def _mix_scored(v):
    shifted = F.transform(F.when(F.col("item_id") % 3 == 0, F.slice("azimuths", 1, F.size("azimuths") - 1)).otherwise(F.col("azimuths")), lambda x: x + 3.0)
    return M.flagged(_mix(v).withColumn("predicted", shifted))


@query("mixture_scores", _MIX + "SELECT item_id, hit AS matched, len(said) > 0 AS answered, len(said) = len(a) AS count_correct, round(hit * 1.0 / len(a), 6) AS recall, CASE WHEN len(said) > 0 THEN round(hit * 1.0 / len(said), 6) END AS precision, hit = len(a) AND len(a) = len(said) AS exact FROM done")
def mixture_scores(v):
    return _mix_scored(v).select("item_id", "matched", "answered", "count_correct", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"), "exact")


@query("mixture_report", _MIX + "SELECT count(*) AS items, count(*) FILTER (WHERE len(said) > 0) AS answered, round(avg(CASE WHEN hit = len(a) AND len(a) = len(said) THEN 1.0 ELSE 0.0 END), 6) AS exact_rate, round(avg(CASE WHEN len(said) = len(a) THEN 1.0 ELSE 0.0 END), 6) AS count_rate, round(avg(hit * 1.0 / len(a)), 6) AS mean_recall, round(avg(CASE WHEN len(said) > 0 THEN hit * 1.0 / len(said) END), 6) AS mean_precision FROM done")
def mixture_report(v):
    return M.report(_mix_scored(v))


@query("mixture_front_end", "WITH t AS (SELECT item_id, count(*) AS n FROM {mix_items} GROUP BY item_id) SELECT count(*) AS items, count(*) FILTER (WHERE item_id % 7 <> 0) AS answered, round(avg(CASE WHEN item_id % 7 <> 0 THEN 1.0 ELSE 0.0 END), 6) AS exact_rate, round(avg(CASE WHEN item_id % 7 <> 0 THEN 1.0 ELSE 0.0 END), 6) AS count_rate, round(avg(CASE WHEN item_id % 7 <> 0 THEN 1.0 ELSE 0.0 END), 6) AS mean_recall, 1.0 AS mean_precision FROM t")
def mixture_front_end(v):
    """Mixtures answered in prose from their own azimuths and read back; a seventh has no evidence and so no answer."""
    items = _mix(v)
    known = items.filter("item_id % 7 <> 0")
    return M.report(M.score(items, known.select("item_id", M.prose(F.col("azimuths")).alias("answer"))))


@query("mixture_constant_count", "WITH t AS (SELECT item_id, count(*) AS n FROM {mix_items} GROUP BY item_id) SELECT count(*) AS items, count(*) AS answered, round(avg(CASE WHEN n = 2 THEN 1.0 ELSE 0.0 END), 6) AS count_rate FROM t")
def mixture_constant_count(v):
    return M.report(M.constant_count(_mix(v), 2)).select("items", "answered", "count_rate")


@query("event_windows", "SELECT time_bucket(INTERVAL '1 day', ts) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def event_windows(v):
    return v.events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("day"), "event_type", "n", "total")


@query("item_prose", "SELECT item_id, CASE WHEN azimuth = 0 THEN concat('The ', instrument, ' is centred, 0 degrees to the left.') ELSE concat('The ', instrument, ' is at ', printf('%.1f', abs(azimuth)), ' degrees to the ', CASE WHEN azimuth > 0 THEN 'left' ELSE 'right' END, '.') END AS prose FROM {items}")
def item_prose(v):
    return v.items.select("item_id", S.prose(F.col("azimuth"), F.col("instrument")).alias("prose"))


@query("prose_roundtrip", "SELECT item_id, azimuth AS recovered FROM {items}")
def prose_roundtrip(v):
    return v.items.select("item_id", (T.signed_azimuth(S.prose(F.col("azimuth"), F.col("instrument"))) + 0.0).alias("recovered"))
