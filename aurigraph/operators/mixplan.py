"""Mixtures from planning to labels: which pieces can be mixed, where their stems stand, renders, evidence and questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import collect, prompts, signals, validate
from .plan import mixture_groups, opaque_ids, published_id, stable_seed, stems_by_piece
from .score import hash_unit


def plans(stems: DataFrame, splits: DataFrame, angles: list[float], clip_s: float, seed: int, key: str = "piece_id") -> DataFrame:
    """A row a piece of 2 to 5 stems that are long enough: its stems in order, as many separated angles, where its excerpt starts, its
    render id, and an opaque public id if it is for testing. Pieces that no angles are found for are left to skipped()."""
    groups = mixture_groups(stems, clip_s, key).filter("status = 'planned'")
    ready = groups.join(stems_by_piece(stems, key), key).join(splits, key)
    rows = collect.separated_angles(ready.select(key, "n", "shortest", "split", F.transform("stems", lambda s: s["stem_id"].cast("string")).alias("stems")), key, "n", angles, seed).filter("angles IS NOT NULL")
    name = F.col(key).cast("string")
    start = hash_unit(F.lit(str(seed)), F.lit("start"), name) * F.greatest(F.col("shortest") - clip_s, F.lit(0.0))
    timed = rows.withColumn("start_s", start).withColumn("render_id", F.concat(F.lit("mixture_"), name, F.lit("_"), F.bround(start * 1000).cast("long").cast("string"), F.lit("ms"))).withColumn("seed", stable_seed(name, seed))
    public = opaque_ids(timed.filter("split = 'test'").select("render_id"), "render_id", seed, "mixture_test_")
    return timed.join(public, "render_id", "left")


def skipped(stems: DataFrame, planned: DataFrame, clip_s: float, key: str = "piece_id") -> DataFrame:
    """(piece): of two stems or more, yet not planned."""
    return mixture_groups(stems, clip_s, key).filter("status <> 'dropped'").select(key).join(planned.select(key), key, "left_anti")


def question(azimuths: Column, public_id: Column, render_id: Column) -> list[Column]:
    """Id, text and answer of a mixture's question; azimuths from left to right."""
    ordered = F.sort_array(azimuths, asc=False)
    return [
        F.concat(published_id(public_id, render_id), F.lit("_mixture")).alias("question_id"),
        F.lit(prompts.MIXTURE_QUESTION).alias("question"),
        F.size(azimuths).alias("answer_count"),
        ordered.alias("answer_azimuths_deg"),
        F.transform(ordered, G.side).alias("answer_sides"),
    ]


def public(items: DataFrame) -> DataFrame:
    """What may be published of mixtures for testing: no count, no azimuth."""
    return items.select("question_id", "split", F.lit("mixture_localization").alias("question_type"), "question")


def private(items: DataFrame) -> DataFrame:
    return items.select("question_id", "answer_count", "answer_azimuths_deg", "answer_sides")


def measured(rendered: DataFrame, keep: list[str], rate: int, most: int | None = None) -> DataFrame:
    """keep columns with the sources found in each render, as `measured` azimuths and shares."""
    return signals.sources(rendered, keep, rate, most).withColumnRenamed("azimuths", "measured")


def checked(found: DataFrame, **limits: float) -> DataFrame:
    """measured() rows with peak and rms_db, validated."""
    return validate.validate_mixture(found, **limits)
