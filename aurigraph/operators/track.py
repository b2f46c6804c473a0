"""Surveys of whole tracks: loud windows measured, known controls planted into the first of them, and a summary a track."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from . import signals, survey

#: Length of a window, how far below the loudest one a window is quiet, angles and chains of the controls.
WINDOW_S, QUIET_DB = 5.0, -40.0
ANGLES = (-25.0, -10.0, 0.0, 10.0, 25.0)
CHAINS = {
    "dry": [],
    "reverb": [("reverb", {"rt60_s": 0.6, "wet": 0.3})],
    "compression": [("compression", {"threshold_db": -18.0, "ratio": 4.0})],
    "width": [("midside", {"width": 1.5})],
    "mastered": [("compression", {"threshold_db": -18.0, "ratio": 4.0}), ("reverb", {"rt60_s": 0.6, "wet": 0.3}), ("midside", {"width": 1.3})],
}
SPREADS = ("ild_db", "estimated_azimuth_deg", "coherence", "itd_us", "ild_flatness_db")


def windows(tracks: DataFrame, rate: int, window_s: float = WINDOW_S, floor_db: float = QUIET_DB) -> DataFrame:
    """(track, start, level, left, right): the loud windows of tracks (track, left, right); a rest at the end goes."""
    n = round(window_s * rate)
    cut = tracks.withColumn("start", F.explode(A.window_starts(F.size("left"), n))).select("track", "start", *[F.slice(c, F.col("start") + 1, n).alias(c) for c in ("left", "right")])
    levels = cut.withColumn("level", A.rms_db(F.col("left"), F.col("right")))
    return survey.loud(levels, "track", "level", floor_db).select("track", "start", "level", "left", "right")


def controls(loud: DataFrame, rate: int, angles: tuple[float, ...] = ANGLES, chains: dict[str, list] | None = None, first: int = 1) -> DataFrame:
    """(track, start, chain, azimuth, cues, error): the downmix of the first windows panned to each angle and sent through each chain."""
    some = survey.first_windows(loud, "track", "start", first).select("track", "start", A.downmix(F.col("left"), F.col("right")).alias("mono"))
    return sweep(some, ["track", "start"], rate, angles, CHAINS if chains is None else chains)


def sweep(monos: DataFrame, keep: list[str], rate: int, angles: tuple[float, ...], chains: dict[str, list], cues: tuple[str, ...] | None = None) -> DataFrame:
    """Each mono signal at each angle through each chain, measured, with the error of its azimuth; or with no more than the cues named."""
    done = signals.swept(monos, keep, rate, angles, chains, cues=cues)
    return done.withColumn("error", F.abs(F.col("estimated_azimuth_deg") - F.col("azimuth"))) if "estimated_azimuth_deg" in done.columns else done


def wet_sweep(monos: DataFrame, keep: list[str], rate: int, angles: tuple[float, ...], wets: tuple[float, ...], rt60_s: float = 0.6, cues: tuple[str, ...] | None = None) -> DataFrame:
    """sweep() over how wet a reverb is."""
    return sweep(monos, keep, rate, angles, {str(w): [("reverb", {"rt60_s": rt60_s, "wet": w})] if w else [] for w in wets}, cues).withColumn("wet", F.col("chain").cast("double")).drop("chain")


def summary(tracks: DataFrame, loud: DataFrame, planted: DataFrame, rate: int) -> DataFrame:
    """A row a track: side level, windows measured, mean, spread and span of each cue, regimes, the mix's pitch, worst controls."""
    seen = signals.measured(loud, ["track", "start", "level"], rate)
    spreads = [c for name in SPREADS for c in (F.round(F.avg(name), 2).alias(f"{name}_mean"), F.round(F.stddev_pop(name), 2).alias(f"{name}_std"), F.round(F.max(name) - F.min(name), 2).alias(f"{name}_span"))]
    per = seen.groupBy("track").agg(F.count("*").alias("windows_measured"), *spreads)
    counts = seen.groupBy("track", "estimated_regime").agg(F.count("*").alias("n")).groupBy("track").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("estimated_regime", "n")))).alias("regimes"))
    worst = planted.groupBy("track", "chain").agg(F.max("error").alias("error")).groupBy("track").agg(F.max("error").alias("worst_control"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("chain", "error")))).alias("worst_by_chain"))
    pitch = signals.mix_pitches(tracks, ["track"], rate).withColumnsRenamed({"f0_hz": "mix_f0_hz", "voiced_share": "mix_voiced_share"})
    sides = tracks.select("track", (F.size("left") / F.lit(float(rate))).alias("duration_s"), F.round(A.side_to_total_db(F.col("left"), F.col("right")), 2).alias("side_to_total_db"))
    return sides.join(per, "track", "left").join(counts, "track", "left").join(worst, "track", "left").join(pitch, "track", "left").fillna(0, ["windows_measured"])


def nested(summaries: DataFrame, loud: DataFrame, planted: DataFrame, rate: int) -> DataFrame:
    """(track, survey): each track's summary with its windows and controls as one JSON object."""
    cues = [c for c in signals.MEASURES if c != "f0_hz"]
    seen = signals.measured(loud, ["track", "start", "level"], rate).groupBy("track").agg(F.array_sort(F.collect_list(F.struct((F.col("start") / F.lit(float(rate))).alias("start_seconds"), F.col("level").alias("rms_dbfs"), F.struct(*cues, "estimated_regime").alias("evidence")))).alias("windows"))
    known = planted.groupBy("track").agg(F.array_sort(F.collect_list(F.struct((F.col("start") / F.lit(float(rate))).alias("start_seconds"), "chain", F.col("azimuth").alias("planted_azimuth_deg"), F.col("estimated_azimuth_deg").alias("recovered_azimuth_deg"), F.col("error").alias("azimuth_error_deg")))).alias("controls"))
    rest = [c for c in summaries.columns if c != "track"]
    whole = summaries.join(seen, "track", "left").join(known, "track", "left")
    return whole.select("track", F.to_json(F.struct(F.col("track").alias("name"), F.struct(*rest).alias("summary"), "windows", "controls")).alias("survey"))
