"""Rules that renders must pass, as ordered lists of failure codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G

#: Fixed values.
ITD_US = 30.0
LEAST_COHERENCE = 0.90


def _beyond(a: Column, b: Column, limit: float) -> Column:
    """False where either is NaN or null, as a NaN fails no comparison."""
    return F.coalesce(~F.isnan(a) & ~F.isnan(b) & (F.abs(a - b) > limit), F.lit(False))


def _codes(*rules: tuple[Column, str]) -> Column:
    return F.filter(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(code)) for broken, code in rules]), lambda x: x.isNotNull())


def _signal(most_peak: float, least_rms_db: float) -> list[tuple[Column, str]]:
    peak, rms = F.col("peak"), F.col("rms_db")
    return [(F.isnan(peak) | F.isnan(rms), "non_finite_samples"), (~F.isnan(peak) & (peak > most_peak), "peak_too_high"), (~F.isnan(rms) & (rms < least_rms_db), "audio_too_quiet")]


def _amplitude(tolerance: float) -> list[tuple[Column, str]]:
    e, low = F.col("expected"), ~F.isnan("coherence") & (F.col("coherence") < LEAST_COHERENCE)
    return [
        (e["azimuth_deg"].isNull(), "azimuth_not_recoverable_after_processing"),
        (_beyond(F.col("estimated_azimuth_deg"), e["azimuth_deg"], tolerance), "azimuth_recovery_failed"),
        (e["itd_us"].isNotNull() & _beyond(F.col("itd_us"), e["itd_us"], ITD_US), "itd_does_not_match_the_processing"),
        (F.col("estimated_regime") != e["regime"], "wrong_regime"),
        (e["coherence_stays_high"] & low, "compact_source_has_low_coherence"),
    ]


def _binaural(tolerance: float) -> list[tuple[Column, str]]:
    expected, found = G.woodworth_us(F.col("azimuth")), F.col("binaural_azimuth_deg")
    return [
        (_beyond(F.col("itd_us"), expected, ITD_US), "binaural_itd_recovery_failed"),
        (F.isnan(found) | found.isNull(), "binaural_azimuth_not_recoverable"),
        (_beyond(found, F.col("azimuth"), tolerance), "binaural_azimuth_recovery_failed"),
        ((F.abs(expected) > ITD_US) & (F.col("estimated_regime") != "delayed"), "binaural_render_does_not_read_as_delayed"),
        (~F.isnan("coherence") & (F.col("coherence") < LEAST_COHERENCE), "compact_source_has_low_coherence"),
    ]


def validate(df: DataFrame, tolerance: float = 5.0, most_peak: float = 0.99, least_rms_db: float = -45.0) -> DataFrame:
    """df (evidence columns, peak, rms_db, azimuth, expected) with failures, in a fixed order."""
    return df.withColumn("failures", _codes(*_signal(most_peak, least_rms_db), *_amplitude(tolerance)))


def validate_binaural(df: DataFrame, tolerance: float = 5.0, most_peak: float = 0.99, least_rms_db: float = -45.0) -> DataFrame:
    """The same for binaural renders, of which only the head's delay tells the azimuth."""
    return df.withColumn("failures", _codes(*_signal(most_peak, least_rms_db), *_binaural(tolerance)))


def validate_any(df: DataFrame, tolerance: float = 5.0, most_peak: float = 0.99, least_rms_db: float = -45.0) -> DataFrame:
    """Renders of either regime (`regime`: amplitude or binaural) with any number of `channels`: what is not stereo fails by that alone."""
    signal = _signal(most_peak, least_rms_db)
    rules = F.when(F.col("regime") == "binaural", _codes(*signal, *_binaural(tolerance))).otherwise(_codes(*signal, *_amplitude(tolerance)))
    return df.withColumn("failures", F.when(F.col("channels") != 2, F.array(F.lit("output_is_not_stereo"))).otherwise(rules))


def validate_mixture(df: DataFrame, tolerance: float = 5.0, most_peak: float = 0.99, least_rms_db: float = -45.0) -> DataFrame:
    """df (peak, rms_db, planted and measured azimuth arrays): a wrong count ends the comparison, else sorted pairs are held."""
    a, b = F.array_sort("planted"), F.array_sort("measured")
    same = F.size("planted") == F.size("measured")
    off = F.exists(F.zip_with(a, b, lambda x, y: F.abs(x - y) > tolerance), lambda x: x)
    return df.withColumn("failures", _codes(*_signal(most_peak, least_rms_db), (~same, "source_count_mismatch"), (same & off, "azimuth_recovery_failed")))


def summary(checked: DataFrame) -> DataFrame:
    ok = F.size("failures") == 0
    return checked.agg(F.count("*").alias("plans"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"))


def reasons(checked: DataFrame) -> DataFrame:
    return checked.select(F.explode("failures").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("failures") == 0).drop("failures")


def rejected(checked: DataFrame, render: list[str], evidence: list[str]) -> DataFrame:
    """(render, measured_evidence, failures) of the rows that fail, plan and evidence as structs."""
    return checked.filter(F.size("failures") > 0).select(F.struct(*render).alias("render"), F.struct(*evidence).alias("measured_evidence"), "failures")


def build_ids(rows: DataFrame, *by: str) -> DataFrame:
    """How many builds the rows are of, how many rows name none, and whether they can be of one build."""
    found = rows.groupBy(*by).agg(F.count_distinct("build_id").alias("ids"), F.count_if(F.col("build_id").isNull()).alias("missing"))
    return found.withColumn("agrees", F.col("ids") <= 1)


def of_one_build(rows: DataFrame) -> DataFrame:
    """rows, with an error where they are of different builds."""
    one = build_ids(rows).select(F.assert_true("agrees", "answers and labels are of different builds").alias("checked"))
    return rows.join(F.broadcast(one), F.col("checked").isNull()).drop("checked")  # one row


def config_failures(df: DataFrame) -> DataFrame:
    """df, a configuration a row (sample_rate, clip_s, angles, tolerance, max_peak, rendering, recipes, tries), with failures."""
    most = F.when(F.col("rendering") == "binaural", 90.0).otherwise(30.0)
    rules = [
        (F.col("sample_rate") <= 0, "sample_rate"),
        (F.col("clip_s") <= 0, "clip"),
        (F.size("angles") == 0, "no_angle"),
        (F.exists("angles", lambda a: F.abs(a) >= most), "angle"),
        (F.col("tolerance") <= 0, "tolerance"),
        (~((F.col("max_peak") > 0) & (F.col("max_peak") <= 1)), "peak"),
        (~F.col("rendering").isin("amplitude", "binaural"), "rendering"),
        ((F.col("rendering") == "binaural") & (F.col("recipes") > 0), "processed_binaural"),
        (F.col("tries") < 1, "tries"),
    ]
    return df.withColumn("failures", _codes(*rules))


def config_errors(config: dict) -> list[str]:
    """What is wrong with a build configuration; [] if nothing."""
    most = 90.0 if config.get("rendering", "amplitude") == "binaural" else 30.0
    angles = config.get("angles_degrees") or []
    rules = [
        (config.get("sample_rate", 0) > 0, "the sample rate must be positive"),
        (config.get("clip_duration_seconds", 0) > 0, "the clip must have a duration"),
        (bool(angles), "there must be an angle"),
        (all(abs(a) < most for a in angles), f"angles must be inside +/-{most:g} degrees"),
        (config.get("azimuth_tolerance_degrees", 0) > 0, "the tolerance must be positive"),
        (0 < config.get("maximum_peak", 0) <= 1, "the peak must be above 0 and at most 1"),
        (config.get("rendering", "amplitude") in ("amplitude", "binaural"), "rendering must be amplitude or binaural"),
        (config.get("rendering", "amplitude") != "binaural" or not config.get("processing_recipes"), "binaural renders take no processing"),
        (config.get("max_excerpt_retries", 1) >= 1, "there must be at least one try"),
    ]
    return [said for holds, said in rules if not holds]
