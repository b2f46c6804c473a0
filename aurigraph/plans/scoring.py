"""Scoring, baselines, confusion and statistics over derived items and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import providers as O
from ..operators import score as S
from . import claims as V
from .registry import query

CLAIMS = V.CLAIMS

SCORED = (
    "WITH texts AS (SELECT i.item_id, coalesce(a.answer, '') AS answer FROM {items} i LEFT JOIN {answers} a ON i.item_id = a.item_id),\n"
    + CLAIMS
    + """,
scored AS (SELECT i.*, f.predicted, abs(f.predicted - i.azimuth) AS abs_error, f.predicted IS NOT NULL AS answered, coalesce(abs(f.predicted - i.azimuth) <= 5.0, false) AS within,
  coalesce(sign(f.predicted) = sign(i.azimuth), false) AS side_correct FROM {items} i JOIN finals f ON i.item_id = f.item_id)
"""
)
REPORT = """count(*) AS items, count(*) FILTER (WHERE answered) AS n_answered, round(avg(CAST(answered AS INT)), 6) AS coverage, round(avg(abs_error), 6) AS mae, round(median(abs_error), 6) AS median_error,
  round(avg(CAST(within AS INT)), 6) AS within_rate, round(avg(CAST(side_correct AS INT)), 6) AS side_rate"""


def _scored(v):
    return S.score(v.items, v.answers)


@query("score_report", SCORED + f"SELECT {REPORT} FROM scored")
def score_report(v):
    return S.report(_scored(v))


@query("score_by_angle", SCORED + "SELECT azimuth, count(*) AS n, round(avg(CAST(within AS INT)), 6) AS within_rate FROM scored GROUP BY azimuth")
def score_by_angle(v):
    return _scored(v).groupBy("azimuth").agg(F.count("*").alias("n"), F.round(S.rate("within"), 6).alias("within_rate")).orderBy("azimuth")


@query("score_items", SCORED + "SELECT item_id, azimuth, predicted, abs_error, answered, within, side_correct FROM scored")
def score_items(v):
    return _scored(v).select("item_id", "azimuth", (F.col("predicted") + 0.0).alias("predicted"), "abs_error", "answered", "within", "side_correct")


@query("score_missing_answers", "SELECT count(*) AS missing FROM {items} i WHERE NOT EXISTS (SELECT 1 FROM {answers} a WHERE a.item_id = i.item_id)")
def score_missing_answers(v):
    return v.items.join(v.answers, "item_id", "left_anti").agg(F.count("*").alias("missing"))


@query("score_by_instrument", SCORED + f"SELECT instrument, {REPORT} FROM scored GROUP BY instrument")
def score_by_instrument(v):
    return S.report(_scored(v), "instrument")


@query("extract_azimuths", "WITH texts AS (SELECT item_id, answer FROM {answers}),\n" + CLAIMS + " SELECT item_id, s AS start_pos, e AS end_pos, magnitude, side FROM claims")
def extract_azimuths(v):
    return v.answers.select("item_id", F.inline_outer(T.azimuth_claims(F.col("answer")))).filter("magnitude IS NOT NULL").select("item_id", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "magnitude", "side")


@query("extract_final_azimuth", "WITH texts AS (SELECT item_id, answer FROM {answers}),\n" + CLAIMS + " SELECT item_id, predicted FROM finals")
def extract_final_azimuth(v):
    return v.answers.select("item_id", (T.signed_azimuth(F.col("answer")) + 0.0).alias("predicted"))


#: SQL of the stated side of answers_audio.
STATED = r"""WITH said AS (SELECT i.item_id, i.stem, i.piece, CASE WHEN i.azimuth > 0 THEN 'left' WHEN i.azimuth < 0 THEN 'right' ELSE 'center' END AS true_side, a.item_id IS NOT NULL AS given,
  CASE lower(regexp_extract(coalesce(a.answer, ''), '(?i)\b(left|right|center|centre)\b', 1)) WHEN '' THEN NULL WHEN 'centre' THEN 'center' ELSE lower(regexp_extract(coalesce(a.answer, ''), '(?i)\b(left|right|center|centre)\b', 1)) END AS said
  FROM {items} i LEFT JOIN {answers_audio} a ON i.item_id = a.item_id)
"""


@query("stated_word_accuracy", STATED + "SELECT count(*) AS total, sum(CASE WHEN said = true_side THEN 1 ELSE 0 END) AS correct FROM said WHERE given")
def stated_word_accuracy(v):
    return S.stated(v.items, v.answers_audio).agg(F.count("*").alias("total"), F.count_if(F.col("said") == F.col("true_side")).alias("correct"))


@query("stated_distribution", STATED + "SELECT said, count(*) AS n FROM said WHERE given GROUP BY said")
def stated_distribution(v):
    return S.stated(v.items, v.answers_audio).groupBy("said").agg(F.count("*").alias("n"))


@query("confusion_matrix", STATED + "SELECT true_side, said, count(*) AS n FROM said WHERE given GROUP BY true_side, said")
def confusion_matrix(v):
    return S.confusion(S.stated(v.items, v.answers_audio))


@query("confusion_pivot", STATED + "SELECT true_side, count(*) FILTER (WHERE said = 'left') AS said_left, count(*) FILTER (WHERE said = 'right') AS said_right, count(*) FILTER (WHERE said = 'center') AS said_center, count(*) FILTER (WHERE said IS NULL) AS said_none FROM said WHERE given GROUP BY true_side")
def confusion_pivot(v):
    wide = S.stated(v.items, v.answers_audio).withColumn("said", F.coalesce("said", F.lit("none"))).groupBy("true_side").pivot("said", ["left", "right", "center", "none"]).count()
    return wide.select("true_side", *[F.coalesce(c, F.lit(0)).alias(f"said_{c}") for c in ("left", "right", "center", "none")])


_RECALL = " + ".join(f"avg(CASE WHEN true_side = '{s}' THEN CASE WHEN said = '{s}' THEN 1.0 ELSE 0.0 END END)" for s in S.SIDES)
_F1 = " + ".join(f"coalesce(2.0 * count(*) FILTER (WHERE said = '{s}' AND true_side = '{s}') / nullif(count(*) FILTER (WHERE said = '{s}') + count(*) FILTER (WHERE true_side = '{s}'), 0), 0.0)" for s in S.SIDES)


@query("balanced_accuracy", STATED + f"SELECT round(({_RECALL}) / 3, 6) AS balanced_accuracy FROM said")
def balanced_accuracy(v):
    return S.stated(v.items, v.answers_audio, "left").agg(F.round(S.balanced_accuracy(F.col("said"), F.col("true_side")), 6).alias("balanced_accuracy"))


@query("macro_f1", STATED + f"SELECT round(({_F1}) / 3, 6) AS macro_f1 FROM said")
def macro_f1(v):
    return S.stated(v.items, v.answers_audio, "left").agg(F.round(S.macro_f1(F.col("said"), F.col("true_side")), 6).alias("macro_f1"))


@query("majority_baseline", STATED + ", counts AS (SELECT true_side AS majority, count(*) AS n FROM said GROUP BY true_side) SELECT majority, n, round(n * 1.0 / (SELECT count(*) FROM said), 6) AS accuracy FROM counts ORDER BY n DESC, majority DESC LIMIT 1")
def majority_baseline(v):
    counts = S.stated(v.items, v.answers_audio, "left").groupBy("true_side").agg(F.count("*").alias("n"))
    top = counts.agg(F.max(F.struct("n", "true_side")).alias("t"), F.sum("n").alias("all"))
    return top.select(F.col("t.true_side").alias("majority"), F.col("t.n").alias("n"), F.round(F.col("t.n") / F.col("all"), 6).alias("accuracy"))


PAIRED = SCORED + ", " + STATED[5:] + """, paired AS (SELECT s.item_id, s.stem, s.piece, coalesce(s.side_correct, false) AS cue_correct, coalesce(d.said = d.true_side, false) AS audio_correct FROM scored s JOIN said d ON s.item_id = d.item_id)
"""


def _paired(v):
    return S.paired(v.items, v.answers, v.answers_audio)


@query("paired_gap", PAIRED + "SELECT count(*) AS n, round(avg(CAST(cue_correct AS INT)), 6) AS cue, round(avg(CAST(audio_correct AS INT)), 6) AS audio, round(avg(CAST(cue_correct AS INT)) - avg(CAST(audio_correct AS INT)), 6) AS gap FROM paired")
def paired_gap(v):
    cue, audio = S.rate("cue_correct"), S.rate("audio_correct")
    return _paired(v).agg(F.count("*").alias("n"), F.round(cue, 6).alias("cue"), F.round(audio, 6).alias("audio"), F.round(cue - audio, 6).alias("gap"))


@query("cluster_grouping_sets", PAIRED + "SELECT stem, piece, count(*) AS n, round(avg(CAST(cue_correct AS INT)) - avg(CAST(audio_correct AS INT)), 6) AS gap FROM paired GROUP BY GROUPING SETS ((stem), (piece))")
def cluster_grouping_sets(v):
    return v.spark.sql("SELECT stem, piece, count(*) AS n, round(avg(CAST(cue_correct AS DOUBLE)) - avg(CAST(audio_correct AS DOUBLE)), 6) AS gap FROM {p} GROUP BY GROUPING SETS ((stem), (piece))", p=_paired(v))


SAMPLES = 20_000


@query(
    "cluster_bootstrap",
    PAIRED
    + f""", sums AS (SELECT piece, count(*) AS n, sum(CAST(cue_correct AS INT)) AS cue, sum(CAST(audio_correct AS INT)) AS audio, row_number() OVER (ORDER BY CAST(piece AS VARCHAR)) - 1 AS k FROM paired GROUP BY piece),
size AS (SELECT count(*) AS c FROM sums), reps AS (SELECT unnest(range(0, {SAMPLES})) AS replicate), draws AS (SELECT replicate, unnest(range(0, (SELECT c FROM size))) AS draw FROM reps),
picked AS (SELECT replicate, CAST(floor(CAST(('0x' || substr(sha256(concat('7:', CAST(replicate AS VARCHAR), ':', CAST(draw AS VARCHAR))), 1, 12))::UBIGINT AS DOUBLE) / 281474976710656.0 * (SELECT c FROM size)) AS BIGINT) AS k FROM draws),
means AS (SELECT replicate, sum(cue) * 1.0 / sum(n) AS cue, sum(audio) * 1.0 / sum(n) AS audio FROM picked JOIN sums ON picked.k = sums.k GROUP BY replicate)
SELECT round(quantile_cont(cue, 0.025), 6) AS cue_low, round(quantile_cont(cue, 0.975), 6) AS cue_high, round(quantile_cont(audio, 0.025), 6) AS audio_low, round(quantile_cont(audio, 0.975), 6) AS audio_high,
  round(quantile_cont(cue - audio, 0.025), 6) AS gap_low, round(quantile_cont(cue - audio, 0.975), 6) AS gap_high FROM means""",
)
def cluster_bootstrap(v):
    return S.cluster_bootstrap(_paired(v), "piece", SAMPLES, 7)


@query("cluster_bootstrap_stem")
def cluster_bootstrap_stem(v):
    """The same over the stems, of which there are as many as customers; a test holds it against a plain loop over the same draws."""
    return S.bootstrap_many(_paired(v), "stem", SAMPLES, 7)


def _baseline_sql(answer: str, source: str = "{items} i") -> str:
    """The scored report of answers that stand for a known signed angle, to one decimal as prose has it."""
    return f"""WITH base AS (SELECT i.item_id, i.azimuth, {answer} AS predicted FROM {source}),
scored AS (SELECT *, abs(predicted - azimuth) AS abs_error, predicted IS NOT NULL AS answered, coalesce(abs(predicted - azimuth) <= 5.0, false) AS within, coalesce(sign(predicted) = sign(azimuth), false) AS side_correct FROM base)
"""


@query("constant_baseline", _baseline_sql("0.0") + f"SELECT {REPORT} FROM scored")
def constant_baseline(v):
    return S.report(S.constant_baseline(v.items))


@query("refusal_baseline", _baseline_sql("CAST(NULL AS DOUBLE)") + f"SELECT {REPORT} FROM scored")
def refusal_baseline(v):
    return S.report(S.refusal_baseline(v.items))


ANGLES = [float(a) for a in range(-25, 30, 5)]
_DRAW = "CAST(floor(CAST(('0x' || substr(sha256(concat('11:', CAST(i.item_id AS VARCHAR))), 1, 12))::UBIGINT AS DOUBLE) / 281474976710656.0 * 11) AS INT) * 5.0 - 25.0"


@query("random_baseline", _baseline_sql(_DRAW) + f"SELECT {REPORT} FROM scored")
def random_baseline(v):
    return S.report(S.random_baseline(v.items, ANGLES, 11))


@query("front_end_baseline", _baseline_sql("e.estimated_azimuth_deg", "{items} i LEFT JOIN {evidence} e ON i.item_id = e.item_id") + f"SELECT {REPORT} FROM scored")
def front_end_baseline(v):
    return S.report(S.front_end_baseline(v.items, v.evidence))


@query(
    "stacked_reports",
    _baseline_sql("0.0").replace("WITH base", "WITH c0", 1).replace("FROM base", "FROM c0").replace("scored AS", "s0 AS")
    + ", " + _baseline_sql("CAST(NULL AS DOUBLE)")[5:].replace("base AS", "c1 AS", 1).replace("FROM base", "FROM c1").replace("scored AS", "s1 AS")
    + ", " + _baseline_sql(_DRAW)[5:].replace("base AS", "c2 AS", 1).replace("FROM base", "FROM c2").replace("scored AS", "s2 AS")
    + ", whole AS (SELECT 'always centre' AS name, * FROM s0 UNION ALL SELECT 'no answer' AS name, * FROM s1 UNION ALL SELECT 'random' AS name, * FROM s2) "
    + f"SELECT name, {REPORT} FROM whole GROUP BY name",
)
def stacked_reports(v):
    return S.stacked({"always centre": S.constant_baseline(v.items), "no answer": S.refusal_baseline(v.items), "random": S.random_baseline(v.items, ANGLES, 11)})


@query("boundary_snap_rate", SCORED + "SELECT round(avg(CASE WHEN abs(predicted) = 30.0 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM scored WHERE answered")
def boundary_snap_rate(v):
    return _scored(v).filter("answered").agg(F.round(S.rate(F.abs("predicted") == 30), 6).alias("rate"))


#: SQL of transcripts scored and verified as answers, where an eighth of the items has no evidence.
FAITHFUL = (
    V.CHECKS
    + """, flags AS (SELECT item_id, bool_and(passed) AS all_passed, bool_and(CASE WHEN kind = 'inference' THEN passed END) AS inference_passed FROM checks WHERE item_id % 8 <> 0 GROUP BY item_id),
told AS (SELECT item_id, azimuth, CASE WHEN azimuth >= 0 THEN 1.0 ELSE -1.0 END * (CAST(abs(azimuth) AS BIGINT) + item_id % 8) + 0.0 AS predicted FROM {items}),
scored AS (SELECT t.item_id, t.azimuth, t.predicted, abs(predicted - azimuth) AS abs_error, true AS answered, abs(predicted - azimuth) <= 5.0 AS within, sign(predicted) = sign(azimuth) AS side_correct, f.all_passed, f.inference_passed
  FROM told t LEFT JOIN flags f ON t.item_id = f.item_id)
"""
)


def _faithful(v):
    return S.score_verified(v.items, v.evidence.filter("item_id % 8 <> 0"), v.transcripts.withColumnRenamed("transcript", "answer"))


@query("score_verified", FAITHFUL + "SELECT item_id, predicted, within, side_correct, all_passed, inference_passed FROM scored")
def score_verified(v):
    return _faithful(v).select("item_id", (F.col("predicted") + 0.0).alias("predicted"), "within", "side_correct", "all_passed", "inference_passed")


@query("full_report", FAITHFUL + f""", angles AS (SELECT azimuth, round(avg(CAST(within AS INT)), 6) AS rate FROM scored GROUP BY azimuth)
SELECT 'model' AS name, 5.0 AS tolerance_deg, {REPORT}, round(avg(CAST(all_passed AS INT)), 6) AS all_passed_rate, round(avg(CAST(inference_passed AS INT)), 6) AS inference_passed_rate,
  (SELECT string_agg(concat(CAST(CAST(azimuth AS INT) AS VARCHAR), '=', printf('%.4f', rate)), ';' ORDER BY azimuth) FROM angles) AS within_by_angle FROM scored""")
def full_report(v):
    entries = F.transform(F.map_entries("within_by_angle"), lambda e: F.concat(e["key"].cast("int").cast("string"), F.lit("="), F.format_string("%.4f", e["value"])))
    return S.full_report(_faithful(v), "model").withColumn("within_by_angle", F.array_join(entries, ";"))


@query("repeated_answers", SCORED.replace("LEFT JOIN {answers} a", "LEFT JOIN (SELECT item_id, max(answer) AS answer FROM (SELECT item_id, answer FROM {answers} UNION ALL SELECT item_id, 'On the left at 5 degrees left.' AS answer FROM {answers}) y GROUP BY item_id) a") + f"SELECT {REPORT} FROM scored")
def repeated_answers(v):
    """An item that is answered twice is still one item."""
    return S.report(S.score(v.items, v.answers.unionByName(v.answers.withColumn("answer", F.lit("On the left at 5 degrees left.")))))


@query("provider_reports", "WITH " + "c AS (SELECT i.item_id, i.azimuth, e.estimated_azimuth_deg AS p FROM {items} i JOIN {evidence} e ON i.item_id = e.item_id) SELECT 'front end' AS name, round(avg(CASE WHEN abs(p - azimuth) <= 5 THEN 1.0 ELSE 0.0 END), 6) AS within_rate FROM c UNION ALL SELECT 'always centre', round(avg(CASE WHEN abs(azimuth) <= 5 THEN 1.0 ELSE 0.0 END), 6) FROM c UNION ALL SELECT 'no answer', 0.0 FROM c GROUP BY 1")
def provider_reports(v):
    """Registered providers answer all items, one report each."""
    rows = v.items.join(v.evidence.drop("azimuth"), "item_id")
    reports = {name: S.score(v.items, O.provider(name)(rows)) for name in ("front end", "always centre", "no answer")}
    return S.stacked(reports).select("name", "within_rate")
