"""Checks of the claims in a transcript against measured evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from .signals import spread

#: Tolerances of the checks.
AZIMUTH_DEG = 5.0
ILD_DB = 1.5
ITD_US = 30.0
COHERENCE = 0.10
F0_SHARE = 0.03
PREMISE_DB = 0.5

_CHECK = "struct<quantity: string, claimed: double, claimed_text: string, measured: double, measured_text: string, tolerance: double, passed: boolean, kind: string>"


def _check(quantity: str, kind: str, passed: Column, claimed: Column | None = None, measured: Column | None = None, tolerance: Column | float | None = None, words: tuple[Column, Column] | None = None) -> Column:
    null_d, null_s = F.lit(None).cast("double"), F.lit(None).cast("string")
    said, found = words or (null_s, null_s)
    limit = tolerance if isinstance(tolerance, Column) else F.lit(tolerance).cast("double")
    return F.struct(F.lit(quantity).alias("quantity"), (null_d if claimed is None else claimed).alias("claimed"), said.alias("claimed_text"), (null_d if measured is None else measured).alias("measured"), found.alias("measured_text"), limit.alias("tolerance"), F.coalesce(passed, F.lit(False)).alias("passed"), F.lit(kind).alias("kind"))


def _within(a: Column, b: Column, limit: Column | float) -> Column:
    """False for NaN on either side."""
    return ~F.isnan(a) & ~F.isnan(b) & (F.abs(a - b) <= limit)


def _in_place(magnitude: Column, side: Column, measured: Column) -> tuple[Column, Column]:
    there = G.side(measured)
    return (there == "center") | (side == there), _within(magnitude, F.abs(measured), AZIMUTH_DEG)


def with_claims(df: DataFrame, transcript: str = "transcript", azimuth: str | None = None) -> DataFrame:
    """df with a column for each kind of claim; azimuth: a column that has the text's final azimuth already."""
    t = F.col(transcript)
    found = {"azimuth": T.final_azimuth(t) if azimuth is None else F.col(azimuth), "ild": T.ild_claim(t), "itd": T.itd_claim(t), "coherence": T.coherence_claim(t), "regime": T.regime_claim(t), "f0": T.f0_claim(t), "premise": T.premise_claim(t)}
    return df.withColumns({f"claim_{k}": v for k, v in found.items()})


def verify(df: DataFrame, transcript: str = "transcript", azimuth: str | None = None) -> DataFrame:
    """df (a transcript and the evidence columns) with checks, all_passed, inference_passed and unparseable.

    Checks stand in a fixed order. Without any check, or any of inference, the flag is false. azimuth: as in with_claims().
    """
    c = {k: F.col(f"claim_{k}") for k in ("azimuth", "ild", "itd", "coherence", "regime", "f0", "premise")}
    measured, f0 = F.col("estimated_azimuth_deg"), F.col("f0_hz")
    side_ok, size_ok = _in_place(c["azimuth"]["magnitude"], c["azimuth"]["side"], measured)
    f0_known = f0.isNotNull() & ~F.isnan(f0)
    implied = F.when(c["premise"]["y"] > 0, 20 * F.log10(c["premise"]["y"]))
    made = [
        (c["azimuth"].isNotNull(), _check("estimated_azimuth_deg_side", "inference", side_ok, words=(c["azimuth"]["side"], G.side(measured)))),
        (c["azimuth"].isNotNull(), _check("estimated_azimuth_deg_magnitude", "inference", size_ok, c["azimuth"]["magnitude"], F.abs(measured), AZIMUTH_DEG)),
        (c["ild"].isNotNull(), _check("ild_db", "read_out", _within(c["ild"]["value"], F.col("ild_db"), ILD_DB), c["ild"]["value"], F.col("ild_db"), ILD_DB)),
        (c["itd"].isNotNull(), _check("itd_us", "read_out", _within(c["itd"]["value"], F.col("itd_us"), ITD_US), c["itd"]["value"], F.col("itd_us"), ITD_US)),
        (c["coherence"].isNotNull(), _check("coherence", "read_out", _within(c["coherence"]["value"], F.col("coherence"), COHERENCE), c["coherence"]["value"], F.col("coherence"), COHERENCE)),
        (c["regime"].isNotNull(), _check("estimated_regime", "inference", c["regime"]["value"] == F.col("estimated_regime"), words=(c["regime"]["value"], F.col("estimated_regime")))),
        (c["f0"].isNotNull() & f0_known, _check("f0_hz", "read_out", _within(c["f0"]["value"], f0, F0_SHARE * f0), c["f0"]["value"], f0, F0_SHARE * f0)),
        (c["premise"].isNotNull(), _check("premise_r_matches_its_own_stated_cue", "inference", _within(implied, c["premise"]["x"], PREMISE_DB), c["premise"]["y"], F.pow(F.lit(10.0), c["premise"]["x"] / 20), PREMISE_DB)),
    ]
    checks = F.filter(F.array(*[F.when(there, check).otherwise(F.lit(None).cast(_CHECK)) for there, check in made]), lambda x: x.isNotNull())
    used = F.filter(F.array(*[F.when(there, F.struct(x["start"].alias("start"), x["end"].alias("end"))) for there, x in ((c["azimuth"].isNotNull(), c["azimuth"]), (c["ild"].isNotNull(), c["ild"]), (c["itd"].isNotNull(), c["itd"]), (c["coherence"].isNotNull(), c["coherence"]), (c["regime"].isNotNull(), c["regime"]), (c["f0"].isNotNull() & f0_known, c["f0"]), (c["premise"].isNotNull(), c["premise"]))]), lambda x: x.isNotNull())
    done = with_claims(spread(df), transcript, azimuth).withColumn("checks", checks).withColumn("used", used)
    inference = F.filter("checks", lambda x: x["kind"] == "inference")

    def held(some: Column) -> Column:
        return (F.size(some) > 0) & F.forall(some, lambda x: x["passed"])

    return done.withColumns({"all_passed": held(F.col("checks")), "inference_passed": held(inference), "unparseable": T.unparsed_sentences(F.col(transcript), F.col("used"))}).drop("used")


def perturbation_of(a: Column, a_measured: Column, b: Column, b_measured: Column) -> Column:
    """Whether the claim follows the measurement from a to b: struct, or null if either has no claim."""
    measured, claimed = b_measured - a_measured, b - a
    tracked = F.when(measured == 0, F.abs(claimed) < AZIMUTH_DEG).otherwise((claimed * measured > 0) & (F.abs(claimed) >= 0.5 * F.abs(measured)))
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("claimed_a"), b.alias("claimed_b"), measured.alias("measured_delta"), claimed.alias("claimed_delta"), tracked.alias("tracked")))


def ablation_of(with_numbers: Column, without: Column, measured: Column) -> Column:
    """Whether a right claim depended on the numbers; null if there is no claim with them."""

    def passes(x: Column) -> Column:
        place, size = _in_place(F.abs(x), G.side(x), measured)
        return F.coalesce(place & size, F.lit(False))

    kept, alone = passes(with_numbers), without.isNotNull() & passes(without)
    return F.when(with_numbers.isNotNull(), F.struct(with_numbers.alias("claimed_with"), without.alias("claimed_without"), kept.alias("with_passed"), alone.alias("without_passed"), (kept & ~alone).alias("relied_on_numbers")))


def listed(df: DataFrame, checks: str = "checks") -> DataFrame:
    """A row for each check. The outer form keeps Spark from testing the array's size, and so building it, before a join as well."""
    rest = [c for c in df.columns if c != checks]
    return df.select(*rest, F.inline_outer(checks)).filter("quantity IS NOT NULL")
