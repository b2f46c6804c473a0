"""Claim extraction and verification over derived transcripts and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import signals as K
from ..operators import verify as V
from .claims import CHECKS, CLAIMED, CLAIMS
from .registry import query


def _claims(v):
    return V.with_claims(K.spread(v.transcripts))


for _name, _column, _sql in (("ild", "value", "ild"), ("itd", "value", "itd"), ("coherence", "value", "coherence"), ("f0", "value", "f0")):

    def _value(v, name=_name):
        return _claims(v).select("item_id", (F.col(f"claim_{name}.value") + 0.0).alias("value"))

    query(f"extract_{_name}", CLAIMED + f"SELECT item_id, {_sql} + 0.0 AS value FROM claims")(_value)


@query("extract_regime", CLAIMED + "SELECT item_id, regime FROM claims")
def extract_regime(v):
    return _claims(v).select("item_id", F.col("claim_regime.value").alias("regime"))


@query("extract_premise", CLAIMED + "SELECT item_id, px AS x, py AS y FROM claims WHERE px IS NOT NULL")
def extract_premise(v):
    return _claims(v).filter("claim_premise IS NOT NULL").select("item_id", F.col("claim_premise.x").alias("x"), F.col("claim_premise.y").alias("y"))


def _verified(v):
    return V.verify(v.transcripts.join(v.evidence.drop("azimuth"), "item_id"))


@query("verify_checks", CHECKS + "SELECT item_id, quantity, passed, kind FROM checks")
def verify_checks(v):
    return V.listed(_verified(v).select("item_id", "checks")).select("item_id", "quantity", "passed", "kind")


@query("verify_summary", CHECKS + "SELECT item_id, count(*) AS n_checks, bool_and(passed) AS all_passed, bool_and(CASE WHEN kind = 'inference' THEN passed END) AS inference_passed FROM checks GROUP BY item_id")
def verify_summary(v):
    return _verified(v).select("item_id", F.size("checks").cast("long").alias("n_checks"), "all_passed", "inference_passed")


@query("verify_rates", CHECKS + "SELECT quantity, kind, count(*) AS n, round(avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END), 6) AS pass_rate FROM checks GROUP BY quantity, kind")
def verify_rates(v):
    return V.listed(_verified(v).select("checks")).groupBy("quantity", "kind").agg(F.count("*").alias("n"), F.round(F.avg(F.col("passed").cast("double")), 6).alias("pass_rate"))


@query("unparseable_sentences", "SELECT item_id, 'About 440 hz.' AS sentence FROM {items} WHERE item_id % 2 = 1 UNION ALL SELECT item_id, concat('The tone is near ', CAST(220 + item_id % 90 AS VARCHAR), ' Hz.') FROM {items} WHERE item_id % 4 = 0")
def unparseable_sentences(v):
    """Sentences with figures that no check read: pitches in a wrong case or of items without one."""
    return _verified(v).select("item_id", F.explode_outer("unparseable").alias("sentence")).filter("sentence IS NOT NULL")


_PAIR = """WITH a AS (SELECT item_id, CASE WHEN azimuth >= 0 THEN 1.0 ELSE -1.0 END * (CAST(abs(azimuth) AS BIGINT) + item_id % 8) + 0.0 AS claimed, estimated_azimuth_deg AS measured FROM {evidence}),
p AS (SELECT x.item_id, x.claimed AS claimed_a, y.claimed AS claimed_b, y.measured - x.measured AS measured_delta, y.claimed - x.claimed AS claimed_delta FROM a x JOIN a y ON y.item_id = x.item_id + 1)
"""


@query("perturbation_pairs", _PAIR + "SELECT item_id, claimed_a, claimed_b, measured_delta, claimed_delta, CASE WHEN measured_delta = 0 THEN abs(claimed_delta) < 5 ELSE claimed_delta * measured_delta > 0 AND abs(claimed_delta) >= 0.5 * abs(measured_delta) END AS tracked FROM p")
def perturbation_pairs(v):
    a = K.spread(v.transcripts).withColumn("claimed", T.signed_azimuth(F.col("transcript"))).join(v.evidence.select("item_id", "estimated_azimuth_deg"), "item_id").select("item_id", "claimed", "estimated_azimuth_deg")
    b = a.select((F.col("item_id") - 1).alias("item_id"), F.col("claimed").alias("claimed_y"), F.col("estimated_azimuth_deg").alias("measured_y"))
    done = a.join(b, "item_id").withColumn("r", V.perturbation_of(F.col("claimed"), F.col("estimated_azimuth_deg"), F.col("claimed_y"), F.col("measured_y")))
    return done.filter("r IS NOT NULL").select("item_id", (F.col("r.claimed_a") + 0.0).alias("claimed_a"), (F.col("r.claimed_b") + 0.0).alias("claimed_b"), "r.measured_delta", "r.claimed_delta", "r.tracked")


@query(
    "ablation_pairs",
    """WITH texts AS (SELECT item_id, answer FROM {answers}), """
    + CLAIMS
    + """, a AS (SELECT e.item_id, CASE WHEN e.azimuth >= 0 THEN 1.0 ELSE -1.0 END * (CAST(abs(e.azimuth) AS BIGINT) + e.item_id % 8) + 0.0 AS claimed_with, f.predicted AS claimed_without, e.estimated_azimuth_deg AS m FROM {evidence} e LEFT JOIN finals f ON e.item_id = f.item_id),
b AS (SELECT *, (m = 0 OR sign(claimed_with) = sign(m)) AND abs(abs(claimed_with) - abs(m)) <= 5 AS with_passed, coalesce((m = 0 OR sign(claimed_without) = sign(m)) AND abs(abs(claimed_without) - abs(m)) <= 5, false) AS without_passed FROM a)
SELECT item_id, claimed_with, claimed_without + 0.0 AS claimed_without, with_passed, without_passed, with_passed AND NOT without_passed AS relied_on_numbers FROM b""",
)
def ablation_pairs(v):
    told = K.spread(v.transcripts).withColumn("claimed", T.signed_azimuth(F.col("transcript"))).join(v.evidence.select("item_id", "estimated_azimuth_deg"), "item_id")
    bare = K.spread(v.answers).select("item_id", T.signed_azimuth(F.col("answer")).alias("bare"))
    done = told.join(bare, "item_id", "left").withColumn("r", V.ablation_of(F.col("claimed"), F.col("bare"), F.col("estimated_azimuth_deg")))
    return done.filter("r IS NOT NULL").select("item_id", (F.col("r.claimed_with") + 0.0).alias("claimed_with"), (F.col("r.claimed_without") + 0.0).alias("claimed_without"), "r.with_passed", "r.without_passed", "r.relied_on_numbers")
