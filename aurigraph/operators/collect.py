"""What surrounds a model: separated angles, dense synthetic examples, dither, outputs of providers, parameter counts."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dsp
from ..functions import geometry as G
from . import prompts
from .score import hash_unit
from .signals import per_row

#: Separation of a mixture's sources, distance from evaluation angles, dither.
SEPARATION_DEG = 10.0
DRAWS = 10_000
EXCLUDED_DEG = 0.2
DITHER = 0.05


def _unit(*parts) -> float:
    """score.hash_unit() of one row."""
    return int(hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()[:12], 16) / float(1 << 48)


def ways(grid: list[float], most: int) -> tuple[list[int], list[list[int]]]:
    """(next, w) of an ascending grid: the place of the first angle that may follow each, and w[k][i], in how many ways k angles, each
    SEPARATION_DEG above the one before, can be taken from place i on."""
    after = [next((j for j in range(i + 1, len(grid)) if grid[j] - grid[i] >= SEPARATION_DEG), len(grid)) for i in range(len(grid))]
    w = [[1] * (len(grid) + 1)]
    for k in range(1, most + 1):
        row = [0] * (len(grid) + 1)
        for i in reversed(range(len(grid))):
            row[i] = row[i + 1] + w[k - 1][after[i]]
        w.append(row)
    return after, w


def pick_separated(name: str, count: int, grid: list[float], seed: int) -> list[float] | None:
    """`count` angles of the grid at least SEPARATION_DEG apart, ascending, one choice of all evenly; separated_angles() of one row."""
    grid = sorted(set(grid))
    after, w = ways(grid, count)
    if not w[count][0]:
        return None
    rank, at, kept = math.floor(_unit(seed, "angles", name) * w[count][0]), 0, []
    while len(kept) < count:
        with_it = w[count - len(kept) - 1][after[at]]
        if rank < with_it:
            kept.append(grid[at])
            at = after[at]
        else:
            rank, at = rank - with_it, at + 1
    return kept


def separated_angles(groups: DataFrame, key: str, count: str, grid: list[float], seed: int) -> DataFrame:
    """groups with `angles`, `count` of the grid's at least SEPARATION_DEG apart, ascending; null where there are no such. Every choice
    is as likely: they are numbered by how many begin with an angle or without it, and a hash of the key picks a number."""
    grid = sorted(set(grid))
    after, w = ways(grid, len(grid))
    table = F.array(*[F.array(*[F.lit(x) for x in row]) for row in w])
    nexts, angles = F.array(*[F.lit(a) for a in after]), F.array(*[F.lit(float(a)) for a in grid])
    n = F.col(count).cast("int")
    ways_of = F.when((n >= 0) & (n <= len(grid)), F.element_at(F.element_at(table, F.greatest(n, F.lit(0)) + 1), 1)).otherwise(0)
    rank = F.floor(hash_unit(F.lit(str(seed)), F.lit("angles"), F.col(key).cast("string")) * ways_of).cast("long")
    start = F.struct(rank.alias("rank"), F.lit(0).alias("free"), F.array().cast("array<double>").alias("kept"))

    def step(s: Column, i: Column) -> Column:
        left = n - F.size(s["kept"])
        with_it = F.element_at(F.element_at(table, F.greatest(left, F.lit(1))), F.element_at(nexts, i + 1) + 1).cast("long")
        taken = F.struct(s["rank"].alias("rank"), F.element_at(nexts, i + 1).alias("free"), F.concat(s["kept"], F.array(F.element_at(angles, i + 1))).alias("kept"))
        passed = F.struct((s["rank"] - with_it).alias("rank"), s["free"].alias("free"), s["kept"].alias("kept"))
        return F.when((left <= 0) | (i < s["free"]), s).when(s["rank"] < with_it, taken).otherwise(passed)

    chosen = F.aggregate(F.sequence(F.lit(0), F.lit(len(grid) - 1)), start, step, lambda s: s["kept"])
    return groups.withColumn("angles", F.when(ways_of > 0, chosen))


def draw_clear(number: int, excluded: list[float], seed: int, limit: float) -> float:
    """An angle within the limit, the first of DRAWS draws that is clear of the excluded ones; an error if none is."""
    for k in range(DRAWS):
        angle = (_unit(seed, number, k) * 2 - 1) * limit
        if all(abs(angle - x) > EXCLUDED_DEG for x in excluded):
            return angle
    raise RuntimeError("no draw was clear of the excluded angles: they leave too little of the range")


def dense_angles(spark, n: int, excluded: list[float], seed: int, limit: float = 25.0) -> DataFrame:
    """(id, azimuth): n angles drawn evenly within the limit and clear of the excluded ones."""
    return per_row(spark.range(n), ["id"], ["id"], lambda i: {"azimuth": draw_clear(i, excluded, seed, limit)}, "azimuth double")


def dense_examples(angles: DataFrame, audio: list[str], instruments: list[str] = ["cello"], keep: tuple[str, ...] = ()) -> DataFrame:
    """Prompts, questions and targets for synthetic evidence at the angles, with the columns of angles that keep names; audio paths and
    instruments are taken in turn."""
    ild = G.ild_of_azimuth(F.col("azimuth"))
    rows = angles.withColumn("ild_db", F.bround(ild, 1)).withColumn("high_frequency_ild_db", F.col("ild_db")).withColumn("ild_flatness_db", F.lit(0.0)).withColumn("itd_us", F.lit(0.0)).withColumn("coherence", F.lit(1.0))

    def turn(values: list[str]) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (F.pmod("id", F.lit(len(values))) + 1).cast("int"))

    who = turn(instruments)
    question = prompts.position_question(who)
    return rows.select("id", "azimuth", *keep, turn(audio).alias("audio_path"), who.alias("instrument"), question.alias("question"), F.concat(prompts.describe_cues("evidence", who), F.lit("\n"), question).alias("prompt"), prompts.faithful_derivation(F.col("ild_db"), F.col("azimuth"), who).alias("target"))


def dithered(df: DataFrame, key: str, seed: int, scale: float = DITHER) -> DataFrame:
    """(key, left, right) with noise of its own on each channel, seeded by the key."""

    def work(k: int, left: list, right: list) -> dict:
        rng = np.random.default_rng([seed, abs(int(k))])
        return {"left": np.array(left) + scale * rng.normal(size=len(left)), "right": np.array(right) + scale * rng.normal(size=len(right))}

    return per_row(df, [key, "left", "right"], [key], work, "left array<double>, right array<double>")


def provider_text(output: Column, depth: int = 3) -> Column:
    """Text of a provider's output: of the first of the keys json_str, text and output of an object that says something, of the first
    item of a list, lists within lists as far as `depth`, or the output itself; trimmed."""

    def of(x: Column, left: int) -> Column:
        own = F.coalesce(*[F.nullif(F.trim(F.get_json_object(x, f"$.{k}")), F.lit("")) for k in ("json_str", "text", "output")])
        plain = F.trim(x)
        if not left:
            return F.coalesce(own, plain)
        first = F.get_json_object(x, "$[0]")
        return F.when(F.ltrim(x).startswith("["), F.coalesce(of(first, left - 1), plain)).when(F.ltrim(x).startswith("{"), F.coalesce(own, plain)).otherwise(plain)

    return of(output, depth)


#: Encoder modes of a fine-tuned adapter, and the parts that a mode trains directly.
ENCODER_MODES = {"qkv": (), "none": (), "all": (), "full": ("audio_tower", "multi_modal_projector"), "projector": ("multi_modal_projector",)}


def adapter_folder(condition: Column, encoder: Column) -> Column:
    """The folder of an adapter; an unknown mode is an error."""
    known = F.when(encoder == "qkv", condition).otherwise(F.concat(condition, F.lit("_enc-"), encoder))
    return F.when(encoder.isin(*ENCODER_MODES), known).otherwise(F.raise_error(F.concat(F.lit("unknown encoder mode "), encoder)).cast("string"))


def directly_trained(encoder: Column) -> Column:
    """The parts that a mode trains directly; none for the others, an error for an unknown one."""
    parts = F.create_map(*[x for mode, own in ENCODER_MODES.items() for x in (F.lit(mode), F.array(*map(F.lit, own)).cast("array<string>"))])
    return F.when(encoder.isin(*ENCODER_MODES), F.try_element_at(parts, encoder)).otherwise(F.raise_error(F.concat(F.lit("unknown encoder mode "), encoder)).cast("array<string>"))


def known_fields(record: Column, names: list[str]) -> Column:
    """The keys of a JSON object that are among the names, sorted."""
    return F.array_sort(F.array_intersect(F.json_object_keys(record), F.array(*map(F.lit, names))))


#: A decimal number of any length, with an exponent or without.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def number_list(text: Column) -> Column:
    """'a,b,c' as doubles; what is no number is null."""
    return F.transform(F.split(text, ","), lambda x: F.when(F.trim(x).rlike(NUMBER), F.trim(x).try_cast("double")))


def parameters_by_component(df: DataFrame, name: str, size: str, trainable: str) -> DataFrame:
    """(component, trainable, total, percent): component is the part of the name before the first dot."""
    rows = df.withColumn("component", F.split(name, r"\.")[0]).groupBy("component").agg(F.sum(F.when(F.col(trainable), F.col(size)).otherwise(0)).alias("trainable"), F.sum(size).alias("total"))
    return rows.withColumn("percent", F.round(F.try_divide(100.0 * F.col("trainable"), F.col("total")), 6))


def regime_vote(left: np.ndarray, right: np.ndarray, rate: int, size: int = 4096) -> dict:
    """A second opinion on the regime from the loudest stretch: cross-correlation, slope of the phase, flatness; two of three win."""
    left, right = dsp.checked(left, right)
    size = min(size, len(left))
    power = dsp.frames(left, size, size).__pow__(2).sum(1) + dsp.frames(right, size, size).__pow__(2).sum(1)
    at = int(power.argmax()) * size
    a, b = left[at : at + size], right[at : at + size]
    delay, _ = dsp.delay_us(a, b, rate)
    spectrum = np.fft.rfft(a * dsp.hann(size)) * np.conj(np.fft.rfft(b * dsp.hann(size)))
    f = np.fft.rfftfreq(size, 1 / rate)
    band = (f > 100) & (f < 8000) & (np.abs(spectrum) > 1e-3 * np.abs(spectrum).max())
    lags = np.arange(-700, 701, 5) * 1e-6
    fit = (np.abs(spectrum[band])[None, :] * np.cos(np.angle(spectrum[band])[None, :] - 2 * np.pi * np.outer(lags, f[band]))).sum(1) if band.any() else np.zeros(len(lags))
    slope = float(lags[int(fit.argmax())] * 1e6)
    flat = dsp.level_cues(a, b, rate)["ild_flatness_db"]
    votes = int(abs(delay) > 30) + int(abs(slope) > 30) + int(flat > 2)
    return {"delay_us": delay, "slope_us": slope, "flatness_db": flat, "regime": "delayed" if votes >= 2 else "amplitude"}


def second_opinion(df: DataFrame, keep: list[str], rate: int) -> DataFrame:
    return per_row(df, ["left", "right"], keep, lambda a, b: regime_vote(np.array(a), np.array(b), rate), "delay_us double, slope_us double, flatness_db double, regime string")


def round_trip_error(azimuth: float) -> float:
    """Degrees lost when a level difference is told to one decimal."""
    d = math.tan(math.radians(azimuth)) / math.tan(math.radians(30))
    return abs(float(dsp.azimuth_of_ild(round(20 * math.log10((1 + d) / (1 - d)), 1))) - azimuth)
