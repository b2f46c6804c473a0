"""Grids of renders, group-safe splits, opaque ids, validation, publication and configuration lint over derived stems."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import numfmt as N
from ..operators import mixplan as X
from ..operators import plan as P
from ..operators import prompts as R
from ..operators import validate as L
from ..sources import records as W
from .registry import query

ANGLES = [float(a) for a in range(-25, 30, 5)]
RECIPES = [[], [("compression", {"threshold_db": -20.0, "ratio": 4.0})], [("midside", {"width": 1.2})], [("delay_widening", {"delay_us": 300.0})]]
_LABELS = ["dry", "compression_ratio4_threshold_dbneg20", "midside_width1p2", "delay_widening_delay_us300"]
CLIP_S = 6.0
SEED = 2026

_UBIG = "('0x' || substr(sha256({0}), 1, 16))::UBIGINT::DECIMAL(20,0)"


@query("stable_seed", "SELECT stem_id, " + _UBIG.format(f"concat('{SEED}:', CAST(stem_id AS VARCHAR))") + " AS seed FROM {stems}")
def stable_seed(v):
    return v.stems.select("stem_id", P.stable_seed(F.col("stem_id"), SEED).alias("seed"))


@query("parse_stems", "SELECT stem_id, CAST(regexp_extract(stem_name, '^AuSep_([0-9]+)_', 1) AS INT) AS track, regexp_extract(stem_name, '^AuSep_[0-9]+_([a-z]+)_', 1) AS code, CASE regexp_extract(stem_name, '^AuSep_[0-9]+_([a-z]+)_', 1) WHEN 'vn' THEN 'violin' WHEN 'vc' THEN 'cello' WHEN 'fl' THEN 'flute' WHEN 'cl' THEN 'clarinet' ELSE 'trumpet' END AS instrument, regexp_extract(stem_name, '^AuSep_[0-9]+_[a-z]+_([0-9]+)_(.+)$', 2) AS piece FROM {stems}")
def parse_stems(v):
    return P.parse_stems(v.stems, "stem_name").select("stem_id", "track", "code", "instrument", "piece")


_SPLIT = """WITH pieces AS (SELECT DISTINCT piece_id FROM {stems}), ranked AS (SELECT piece_id, row_number() OVER (ORDER BY sha256(concat('2026:', CAST(piece_id AS VARCHAR))), piece_id) - 1 AS k, count(*) OVER () AS n FROM pieces),
ends AS (SELECT *, CAST(floor(n * 0.7 + 0.5) AS BIGINT) AS t, CAST(floor(n * 0.15 + 0.5) AS BIGINT) AS d FROM ranked),
splits AS (SELECT piece_id, CASE WHEN k < t THEN 'train' WHEN k < t + d THEN 'dev' ELSE 'test' END AS split FROM ends)
"""


def _splits(v):
    return P.assign_splits(v.stems.select("piece_id").distinct(), "piece_id", SEED)


@query("split_assign", _SPLIT + "SELECT piece_id, split FROM splits")
def split_assign(v):
    return _splits(v)


@query("split_coverage", _SPLIT + "SELECT count(*) AS missing FROM (SELECT DISTINCT piece_id FROM {stems} EXCEPT SELECT piece_id FROM splits) x")
def split_coverage(v):
    return P.uncovered(v.stems.select("piece_id").distinct(), _splits(v), "piece_id").agg(F.count("*").alias("missing"))


_LABEL_SQL = "CASE r " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_LABELS)) + " END"
PLANS = _SPLIT + f""", plans AS (SELECT s.stem_id, s.piece_id, p.split, CAST(a.angle AS DOUBLE) AS azimuth, r, concat(CAST(s.stem_id AS VARCHAR), '_amp_', CASE WHEN a.angle < 0 THEN 'neg' ELSE 'p' END, CAST(abs(a.angle) AS VARCHAR), '_0ms', CASE WHEN r = 0 THEN '' ELSE concat('_', {_LABEL_SQL}) END) AS render_id
  FROM {{stems}} s JOIN splits p ON s.piece_id = p.piece_id, (SELECT unnest(range(-25, 30, 5)) AS angle) a, (SELECT unnest(range(0, 4)) AS r) q WHERE s.frames >= 6.0 * s.sample_rate)
"""


def _plans(v, **more):
    return P.render_plans(v.stems, _splits(v), ANGLES, RECIPES, CLIP_S, more=more)


@query("render_plan_expand", PLANS + "SELECT stem_id, split, azimuth, render_id FROM plans")
def render_plan_expand(v):
    return _plans(v).select("stem_id", "split", "azimuth", "render_id")


@query("opaque_ids", PLANS + "SELECT render_id, concat('item_test_', lpad(k, CAST(greatest(5, length(k)) AS INT), '0')) AS public_id FROM (SELECT render_id, CAST(row_number() OVER (ORDER BY sha256(concat('2026:', render_id)), render_id) - 1 AS VARCHAR) AS k FROM plans WHERE split = 'test') x")
def opaque_ids(v):
    return P.opaque_ids(_plans(v).filter("split = 'test'"), "render_id", SEED, "item_test_").select("render_id", "public_id")


@query("expected_cues", PLANS + """SELECT render_id, round(CASE WHEN r = 2 THEN degrees(atan(1.2 * tan(radians(azimuth)))) ELSE azimuth END, 6) + 0.0 AS azimuth_deg, CASE WHEN r = 3 THEN 300.0 ELSE 0.0 END AS itd_us, CASE WHEN r = 3 THEN 'delayed' ELSE 'amplitude' END AS regime, true AS coherence_stays_high FROM plans""")
def expected_cues(v):
    done = _plans(v, e=G.expected_cues(F.col("azimuth"), F.col("processing")))
    return done.select("render_id", (F.round("e.azimuth_deg", 6) + 0.0).alias("azimuth_deg"), "e.itd_us", "e.regime", "e.coherence_stays_high")


@query("processing_labels", PLANS + f"SELECT {_LABEL_SQL} AS label, count(*) AS n FROM plans GROUP BY 1")
def processing_labels(v):
    return _plans(v).withColumn("label", N.processing_label(F.col("processing"))).groupBy("label").agg(F.count("*").alias("n"))


@query("questions", PLANS + "SELECT concat(render_id, '_absolute') AS question_id, concat('Where is the ', CAST(stem_id AS VARCHAR), ' positioned in the stereo image? Return its side and azimuth in degrees.') AS question, CASE WHEN azimuth > 0 THEN 'left' WHEN azimuth < 0 THEN 'right' ELSE 'center' END AS answer_side FROM plans WHERE r = 0")
def questions(v):
    return _plans(v).filter("size(processing) = 0").select(*P.question(F.col("render_id"), F.col("stem_id").cast("string"), F.col("azimuth")))


FAILED = """WITH checked AS (SELECT item_id, azimuth, concat_ws(',', CASE WHEN peak > 0.99 THEN 'peak_too_high' END, CASE WHEN rms_db < -45.0 THEN 'audio_too_quiet' END,
  CASE WHEN abs(estimated_azimuth_deg - azimuth) > 2.0 THEN 'azimuth_recovery_failed' END, CASE WHEN abs(itd_us - 0.0) > 30.0 THEN 'itd_does_not_match_the_processing' END,
  CASE WHEN estimated_regime <> 'amplitude' THEN 'wrong_regime' END, CASE WHEN coherence < 0.9 THEN 'compact_source_has_low_coherence' END) AS failures FROM {evidence})
"""


def _checked(v):
    return L.validate(v.evidence.withColumn("expected", G.expected_cues(F.col("azimuth"), F.array().cast("array<struct<kind: string, params: map<string, double>>>"))), tolerance=2.0)


@query("validate_failures", FAILED + "SELECT item_id, failures FROM checked")
def validate_failures(v):
    return _checked(v).select("item_id", F.array_join("failures", ",").alias("failures"))


_BINAURAL = "CAST(0.0875 / 343.0 * 1e6 AS DOUBLE) * (radians(azimuth) + sin(radians(azimuth)))"


@query("validate_binaural", f"""WITH e AS (SELECT *, {_BINAURAL} AS expected, CASE WHEN item_id % 13 = 0 THEN NULL ELSE estimated_azimuth_deg END AS found FROM {{evidence}})
SELECT item_id, concat_ws(',', CASE WHEN peak > 0.99 THEN 'peak_too_high' END, CASE WHEN rms_db < -45.0 THEN 'audio_too_quiet' END, CASE WHEN abs(itd_us - expected) > 30.0 THEN 'binaural_itd_recovery_failed' END, CASE WHEN found IS NULL THEN 'binaural_azimuth_not_recoverable' WHEN abs(found - azimuth) > 2.0 THEN 'binaural_azimuth_recovery_failed' END,
  CASE WHEN abs(expected) > 30.0 AND estimated_regime <> 'delayed' THEN 'binaural_render_does_not_read_as_delayed' END, CASE WHEN coherence < 0.9 THEN 'compact_source_has_low_coherence' END) AS failures FROM e""")
def validate_binaural(v):
    e = v.evidence.withColumn("binaural_azimuth_deg", F.when(F.col("item_id") % 13 == 0, F.lit(float("nan"))).otherwise(F.col("estimated_azimuth_deg")))
    return L.validate_binaural(e, tolerance=2.0).select("item_id", F.array_join("failures", ",").alias("failures"))


@query("accept_reject_counts", FAILED + "SELECT count(*) AS plans, count(*) FILTER (WHERE failures = '') AS accepted, count(*) FILTER (WHERE failures <> '') AS rejected FROM checked")
def accept_reject_counts(v):
    return L.summary(_checked(v))


@query("failure_reason_counts", FAILED + "SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(failures, ',')) AS reason FROM checked WHERE failures <> '') x GROUP BY reason")
def failure_reason_counts(v):
    return L.reasons(_checked(v))


@query("public_projection", PLANS + "SELECT concat('item_', render_id) AS item_id, split, 'absolute_localization' AS question_type FROM plans WHERE split = 'test'")
def public_projection(v):
    return P.public(_plans(v).filter("split = 'test'").withColumn("item_id", F.concat(F.lit("item_"), "render_id")).withColumn("question_type", F.lit("absolute_localization")).withColumn("answer_side", G.side(F.col("azimuth"))))


@query("private_projection", PLANS + "SELECT concat('item_', render_id) AS item_id, CASE WHEN azimuth > 0 THEN 'left' WHEN azimuth < 0 THEN 'right' ELSE 'center' END AS answer_side, azimuth AS answer_azimuth_deg FROM plans WHERE split = 'test'")
def private_projection(v):
    return _plans(v).filter("split = 'test'").select(F.concat(F.lit("item_"), "render_id").alias("item_id"), G.side(F.col("azimuth")).alias("answer_side"), F.col("azimuth").alias("answer_azimuth_deg"))


@query("build_id_guard", "SELECT b AS batch, count(DISTINCT build_id) AS ids, count(*) FILTER (WHERE build_id IS NULL) AS missing, count(DISTINCT build_id) <= 1 AS agrees FROM (SELECT o_custkey AS b, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS build_id FROM orders) x GROUP BY b")
def build_id_guard(v):
    """Batches of rows with build ids, of which few are of one build; what raises on the others is tested."""
    rows = v.orders.select(F.col("o_custkey").alias("batch"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("build_id"))
    return L.build_ids(rows, "batch")


@query("config_errors", """SELECT id, concat_ws(',', CASE WHEN sr <= 0 THEN 'sample_rate' END, CASE WHEN clip <= 0 THEN 'clip' END, CASE WHEN id % 7 = 3 THEN 'no_angle' END, CASE WHEN id % 7 <> 3 AND a >= CASE WHEN r = 'binaural' THEN 90.0 ELSE 30.0 END THEN 'angle' END, CASE WHEN tol <= 0 THEN 'tolerance' END,
  CASE WHEN peak <= 0 OR peak > 1 THEN 'peak' END, CASE WHEN r NOT IN ('amplitude', 'binaural') THEN 'rendering' END, CASE WHEN r = 'binaural' AND recipes > 0 THEN 'processed_binaural' END, CASE WHEN tries < 1 THEN 'tries' END) AS failures
  FROM (SELECT o_orderkey AS id, o_orderkey % 5 * 12000 AS sr, o_orderkey % 4 * 2.0 AS clip, o_orderkey % 9 * 12.0 AS a, o_orderkey % 6 * 1.0 AS tol, o_orderkey % 8 * 0.2 AS peak, CASE o_orderkey % 3 WHEN 0 THEN 'amplitude' WHEN 1 THEN 'binaural' ELSE 'other' END AS r, o_orderkey % 2 AS recipes, o_orderkey % 11 AS tries FROM orders) x""")
def config_errors(v):
    """A configuration for each order, with every rule broken by some."""
    k = F.col("o_orderkey")
    rows = v.orders.select(
        k.alias("id"), (k % 5 * 12000).alias("sample_rate"), (k % 4 * 2.0).alias("clip_s"), F.when(k % 7 == 3, F.array().cast("array<double>")).otherwise(F.array(-(k % 9 * 12.0), F.lit(0.0))).alias("angles"), (k % 6 * 1.0).alias("tolerance"), (k % 8 * 0.2).alias("max_peak"),
        F.element_at(F.array(*map(F.lit, ("amplitude", "binaural", "other"))), (k % 3 + 1).cast("int")).alias("rendering"), (k % 2).alias("recipes"), (k % 11).alias("tries"),
    )
    return L.config_failures(rows).select("id", F.array_join("failures", ",").alias("failures"))


@query("excerpt_retry", "SELECT stem_id, coalesce(min(CASE WHEN (stem_id * 7 + k * 3) % 10 >= 4 THEN k END), 3) AS attempt FROM {stems}, (SELECT unnest(range(0, 4)) AS k) q GROUP BY stem_id")
def excerpt_retry(v):
    return P.first_loud(v.stems, 4, lambda k: (F.col("stem_id") * 7 + k * 3) % 10 >= 4).select("stem_id", "attempt")


@query("systematic_sample", "SELECT stem_id FROM (SELECT stem_id, row_number() OVER (ORDER BY stem_id) - 1 AS k FROM {stems}) x WHERE k % 7 = 0 AND k / 7 < 20")
def systematic_sample(v):
    return P.every_nth(v.stems, "stem_id", 7, 20).select("stem_id")


@query("seeded_sample", "SELECT stem_id FROM {stems} ORDER BY sha256(concat('5:', CAST(stem_id AS VARCHAR))), stem_id LIMIT 25")
def seeded_sample(v):
    return P.seeded_sample(v.stems, "stem_id", 25, 5).select("stem_id")


@query("shuffle_within_groups", "WITH a AS (SELECT piece_id, stem_id, frames, row_number() OVER (PARTITION BY piece_id ORDER BY stem_id) AS k, row_number() OVER (PARTITION BY piece_id ORDER BY sha256(concat('3:', CAST(stem_id AS VARCHAR))), stem_id) AS s FROM {stems}) SELECT x.stem_id, y.frames AS shuffled FROM a x JOIN a y ON x.piece_id = y.piece_id AND x.k = y.s")
def shuffle_within_groups(v):
    return P.shuffle_within(v.stems, "piece_id", "stem_id", "frames", 3).select("stem_id", "shuffled")


@query("resume_anti_join", "SELECT item_id FROM {items} WHERE item_id NOT IN (SELECT item_id FROM {answers})")
def resume_anti_join(v):
    return P.pending(v.items, v.answers, "item_id").select("item_id")


@query("pilot_semi_join", "SELECT item_id, azimuth FROM {items} WHERE item_id IN (SELECT item_id FROM {items} ORDER BY sha256(concat('9:', CAST(item_id AS VARCHAR))), item_id LIMIT 15)")
def pilot_semi_join(v):
    return v.items.join(P.seeded_sample(v.items, "item_id", 15, 9).select("item_id"), "item_id", "left_semi").select("item_id", "azimuth")


@query("last_answer_wins", "SELECT o_custkey AS item_id, arg_max(o_orderpriority, o_orderkey) AS answer FROM orders GROUP BY o_custkey")
def last_answer_wins(v):
    return P.keep_last(v.orders, "o_custkey", "o_orderkey").select(F.col("o_custkey").alias("item_id"), F.col("o_orderpriority").alias("answer"))


@query("mixture_plan", "WITH g AS (SELECT piece_id, count(*) AS n, min(frames) AS shortest FROM {stems} GROUP BY piece_id) SELECT piece_id, n, CASE WHEN n < 2 THEN 'dropped' WHEN n > 5 OR shortest < 6.0 * 48000 THEN 'skipped' ELSE 'planned' END AS status FROM g")
def mixture_plan(v):
    return P.mixture_groups(v.stems, CLIP_S).select("piece_id", "n", "status")


_BOTH = """WITH e AS (SELECT *, CASE WHEN item_id % 17 = 0 THEN 1 ELSE 2 END AS channels, CASE WHEN item_id % 3 = 0 THEN 'binaural' ELSE 'amplitude' END AS regime, CAST(0.0875 / 343.0 * 1e6 AS DOUBLE) * (radians(azimuth) + sin(radians(azimuth))) AS expected FROM {evidence}),
checked AS (SELECT *, CASE WHEN channels <> 2 THEN 'output_is_not_stereo' ELSE concat_ws(',', CASE WHEN peak > 0.99 THEN 'peak_too_high' END, CASE WHEN rms_db < -45.0 THEN 'audio_too_quiet' END,
  CASE WHEN regime = 'binaural' AND abs(itd_us - expected) > 30.0 THEN 'binaural_itd_recovery_failed' END, CASE WHEN regime = 'binaural' AND abs(estimated_azimuth_deg - azimuth) > 2.0 THEN 'binaural_azimuth_recovery_failed' END,
  CASE WHEN regime = 'binaural' AND abs(expected) > 30.0 AND estimated_regime <> 'delayed' THEN 'binaural_render_does_not_read_as_delayed' END,
  CASE WHEN regime <> 'binaural' AND abs(estimated_azimuth_deg - azimuth) > 2.0 THEN 'azimuth_recovery_failed' END, CASE WHEN regime <> 'binaural' AND abs(itd_us) > 30.0 THEN 'itd_does_not_match_the_processing' END,
  CASE WHEN regime <> 'binaural' AND estimated_regime <> 'amplitude' THEN 'wrong_regime' END, CASE WHEN coherence < 0.9 THEN 'compact_source_has_low_coherence' END) END AS failures FROM e)
"""


def _both(v):
    e = v.evidence.withColumns({"channels": F.when(F.col("item_id") % 17 == 0, 1).otherwise(2), "regime": F.when(F.col("item_id") % 3 == 0, "binaural").otherwise("amplitude"), "binaural_azimuth_deg": F.col("estimated_azimuth_deg")})
    return L.validate_any(e.withColumn("expected", G.expected_cues(F.col("azimuth"), F.array().cast("array<struct<kind: string, params: map<string, double>>>"))), tolerance=2.0)


@query("validate_dispatch", _BOTH + "SELECT item_id, failures FROM checked")
def validate_dispatch(v):
    return _both(v).select("item_id", F.array_join("failures", ",").alias("failures"))


@query("rejected_rows", _BOTH + "SELECT item_id, azimuth, regime, estimated_azimuth_deg, itd_us, coherence, failures FROM checked WHERE failures <> ''")
def rejected_rows(v):
    """What is rejected keeps its plan and its evidence."""
    out = L.rejected(_both(v), ["item_id", "azimuth", "regime"], ["estimated_azimuth_deg", "itd_us", "coherence"])
    return out.select("render.*", "measured_evidence.*", F.array_join("failures", ",").alias("failures"))


@query("accepted_rows", _BOTH + "SELECT item_id, azimuth, estimated_azimuth_deg FROM checked WHERE failures = ''")
def accepted_rows(v):
    return L.accepted(_both(v)).select("item_id", "azimuth", "estimated_azimuth_deg")


_MIXABLE = """WITH g AS (SELECT piece_id, count(*) AS n, min(frames / sample_rate) AS shortest, string_agg(concat(instrument_code, ':', CAST(stem_id AS VARCHAR)), ',' ORDER BY instrument_code, stem_id) AS stems FROM {ensembles} GROUP BY piece_id),
s AS (SELECT *, CASE WHEN n < 2 THEN 'dropped' WHEN n > 5 OR shortest < 6.0 THEN 'skipped' ELSE 'planned' END AS status FROM g)
"""
_START = "CAST(('0x' || substr(sha256(concat('2026:start:', CAST(piece_id AS VARCHAR))), 1, 12))::UBIGINT AS DOUBLE) / 281474976710656.0 * greatest(shortest - 6.0, 0)"


def _ensemble_splits(v):
    return P.assign_splits(v.ensembles.select("piece_id").distinct(), "piece_id", SEED)


@query("stems_by_piece", _MIXABLE + "SELECT piece_id, stems FROM s")
def stems_by_piece(v):
    return P.stems_by_piece(v.ensembles).select("piece_id", F.array_join(F.transform("stems", lambda s: F.concat_ws(":", s["code"], s["stem_id"].cast("string"))), ",").alias("stems"))


@query("mixture_plans", _MIXABLE + f"SELECT piece_id, n, round({_START}, 6) AS start_s, concat('mixture_', CAST(piece_id AS VARCHAR), '_', CAST(CAST(round_even({_START} * 1000, 0) AS BIGINT) AS VARCHAR), 'ms') AS render_id, true AS separated FROM s WHERE status = 'planned'")
def mixture_plans(v):
    """Whole plans of pieces that can be mixed: their stems' angles are apart, in order and of the grid."""
    found = X.plans(v.ensembles, _ensemble_splits(v), ANGLES, CLIP_S, SEED)
    a = F.col("angles")
    apart = (F.size(a) == F.col("n")) & F.forall(F.sequence(F.lit(1), F.size(a) - 1), lambda i: F.element_at(a, i + 1) - F.element_at(a, i) >= 10.0) & F.forall(a, lambda x: F.array_contains(F.array(*map(F.lit, ANGLES)), x))
    return found.select("piece_id", "n", F.round("start_s", 6).alias("start_s"), "render_id", apart.alias("separated"))


@query("mixture_skipped", _MIXABLE + "SELECT piece_id FROM s WHERE status = 'skipped'")
def mixture_skipped(v):
    return X.skipped(v.ensembles, X.plans(v.ensembles, _ensemble_splits(v), ANGLES, CLIP_S, SEED), CLIP_S)


@query("build_summary", _MIXABLE + "SELECT (SELECT count(*) FROM {ensembles}) AS inventory_stems, count(*) FILTER (WHERE status = 'planned') AS eligible_pieces, count(*) FILTER (WHERE status = 'skipped') AS skipped_pieces FROM s")
def build_summary(v):
    planned = X.plans(v.ensembles, _ensemble_splits(v), ANGLES, CLIP_S, SEED)
    counts = [v.ensembles.agg(F.count("*").alias("inventory_stems")), planned.agg(F.count_distinct("piece_id").alias("eligible_pieces")), X.skipped(v.ensembles, planned, CLIP_S).agg(F.count("*").alias("skipped_pieces"))]
    one = [c.withColumn("one", F.lit(1)) for c in counts]  # a row each
    return one[0].join(one[1], "one").join(one[2], "one").drop("one")


_PLANTED = """WITH m AS (SELECT item_id, list(azimuth ORDER BY azimuth DESC) AS a FROM {mix_items} GROUP BY item_id)
"""


def _planted(v):
    return v.mix_items.groupBy("item_id").agg(F.collect_list("azimuth").alias("azimuths")).withColumn("public_id", F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("mixture_test_"), P.padded(F.col("item_id")))).otherwise("")).withColumn("render_id", F.concat(F.lit("mixture_"), F.col("item_id").cast("string")))


_MIX_ID = "concat(CASE WHEN item_id % 2 = 0 THEN concat('mixture_test_', lpad(CAST(item_id AS VARCHAR), CAST(greatest(5, length(CAST(item_id AS VARCHAR))) AS INT), '0')) ELSE concat('mixture_', CAST(item_id AS VARCHAR)) END, '_mixture')"


@query("mixture_questions", _PLANTED + f"SELECT {_MIX_ID} AS question_id, len(a) AS answer_count, array_to_string(list_transform(a, lambda x: CAST(CAST(x AS INT) AS VARCHAR)), ',') AS azimuths, array_to_string(list_transform(a, lambda x: CASE WHEN x > 0 THEN 'left' WHEN x < 0 THEN 'right' ELSE 'center' END), ',') AS sides FROM m")
def mixture_questions(v):
    asked = _planted(v).select(*X.question(F.col("azimuths"), F.col("public_id"), F.col("render_id")))
    return X.private(asked).select("question_id", F.col("answer_count").cast("long").alias("answer_count"), F.array_join(F.transform("answer_azimuths_deg", lambda x: x.cast("int").cast("string")), ",").alias("azimuths"), F.array_join("answer_sides", ",").alias("sides"))


@query("mixture_public", _PLANTED + f"SELECT {_MIX_ID} AS question_id, 'test' AS split, 'mixture_localization' AS question_type, '{R.MIXTURE_QUESTION}' AS question FROM m")
def mixture_public(v):
    return X.public(_planted(v).select(*X.question(F.col("azimuths"), F.col("public_id"), F.col("render_id"))).withColumn("split", F.lit("test")))


@query("validate_mixtures", """WITH m AS (SELECT item_id, list(azimuth ORDER BY azimuth) AS a FROM {mix_items} GROUP BY item_id),
f AS (SELECT item_id, a, CASE WHEN item_id % 4 = 0 THEN a[1:len(a) - 1] ELSE list_transform(a, lambda x: x + item_id % 8) END AS b, (item_id % 9) * 0.15 AS peak FROM m)
SELECT item_id, concat_ws(',', CASE WHEN peak > 0.99 THEN 'peak_too_high' END, CASE WHEN len(a) <> len(b) THEN 'source_count_mismatch' WHEN item_id % 8 > 5 THEN 'azimuth_recovery_failed' END) AS failures FROM f""")
def validate_mixtures(v):
    rows = v.mix_items.groupBy("item_id").agg(F.array_sort(F.collect_list("azimuth")).alias("planted"))
    seen = F.when(F.col("item_id") % 4 == 0, F.slice("planted", 1, F.size("planted") - 1)).otherwise(F.transform("planted", lambda x: x + F.col("item_id") % 8))
    return X.checked(rows.withColumn("measured", seen).withColumn("peak", (F.col("item_id") % 9) * 0.15).withColumn("rms_db", F.lit(-20.0))).select("item_id", F.array_join("failures", ",").alias("failures"))


@query("published_ids", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN concat('public_', CAST(o_orderkey AS VARCHAR)) ELSE concat('render_', CAST(o_orderkey AS VARCHAR)) END AS published FROM orders")
def published_ids(v):
    k = F.col("o_orderkey")
    public = F.when(k % 3 == 0, F.concat(F.lit("public_"), k.cast("string"))).when(k % 3 == 1, "")
    return v.orders.select(k.alias("id"), P.published_id(public, F.concat(F.lit("render_"), k.cast("string"))).alias("published"))


@query("answerable_azimuths", PLANS + "SELECT render_id, round(CASE WHEN r = 2 AND stem_id % 2 = 0 THEN degrees(atan(1.2 * tan(radians(azimuth)))) ELSE azimuth END, 6) + 0.0 AS azimuth FROM plans")
def answerable_azimuths(v):
    regime = F.when(F.col("stem_id") % 2 == 0, "amplitude").otherwise("binaural")
    return _plans(v).select("render_id", (F.round(P.answerable_azimuth(F.col("azimuth"), F.col("processing"), regime), 6) + 0.0).alias("azimuth"))


@query("fixed_items", "SELECT stem_id, CASE stem_id WHEN 7 THEN 1 WHEN 2 THEN 2 WHEN 31 THEN 3 END AS place FROM {stems} WHERE stem_id IN (7, 2, 31)")
def fixed_items(v):
    return P.by_ids(v.stems, "stem_id", [7, 2, 31]).select("stem_id", "place")


@query("ordered_dedupe", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def ordered_dedupe(v):
    return P.first_of_each(v.orders, "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey")


@query("one_a_page", """WITH RECURSIVE r AS (SELECT n_regionkey AS page, n_nationkey AS k, n_nationkey % 7 AS artist FROM nation),
t AS (SELECT 0 AS page, (SELECT min(k) FROM r WHERE page = 0) AS k, [(SELECT arg_min(artist, k) FROM r WHERE page = 0)] AS seen
  UNION ALL SELECT t.page + 1, (SELECT min(k) FROM r WHERE r.page = t.page + 1 AND NOT list_contains(t.seen, r.artist)), list_concat(t.seen, [(SELECT arg_min(artist, k) FROM r WHERE r.page = t.page + 1 AND NOT list_contains(t.seen, r.artist))]) FROM t WHERE t.page < 4)
SELECT k FROM t WHERE k IS NOT NULL""")
def one_a_page(v):
    rows = v.nation.select(F.col("n_regionkey").alias("page"), F.col("n_nationkey").alias("k"), (F.col("n_nationkey") % 7).alias("artist"))
    return P.one_a_page(rows, "page", "k", "artist").select("k")


@query("instrument_codes", "SELECT stem_id, instrument_code AS code, concat('F0s_', substr(stem_name, 7), '.txt') AS annotation FROM {stems}")
def instrument_codes(v):
    path = F.concat(F.lit("a/b/"), "stem_name", F.lit(".wav"))
    return v.stems.select("stem_id", P.instrument_code(F.col("stem_name")).alias("code"), F.regexp_extract(W.annotation_paths(path)[1], "([^/]*)$", 1).alias("annotation"))
