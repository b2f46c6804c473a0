"""Operators on signals held as ARRAY<DOUBLE>, by higher-order functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def power(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)


def peak(x: Column) -> Column:
    return F.array_max(F.transform(x, F.abs))


def rms_db(*channels: Column) -> Column:
    """Level of all samples of the channels; -inf for silence, null for none."""
    n = sum((F.size(c) for c in channels), F.lit(0))
    rms = F.sqrt(F.try_divide(sum((power(c) for c in channels), F.lit(0.0)), n))
    return F.when(rms <= 2.220446049250313e-16, F.lit(-math.inf)).otherwise(20 * F.log10(rms))


def side_to_total_db(left: Column, right: Column) -> Column:
    """10 log10 of the mean squared difference over the mean square of all samples."""
    difference = F.aggregate(F.zip_with(left, right, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    every = power(left) + power(right)
    ratio = F.try_divide(difference / F.size(left), every / (2 * F.size(left)))
    return F.when(difference <= 0, F.lit(-math.inf)).otherwise(10 * F.log10(ratio))


def width(left: Column, right: Column, w: Column | float) -> tuple[Column, Column]:
    """Mid/side width: (left, right)."""
    w = F.lit(w) if isinstance(w, (int, float)) else w
    return F.zip_with(left, right, lambda a, b: (a + b) / 2 + w * (a - b) / 2), F.zip_with(left, right, lambda a, b: (a + b) / 2 - w * (a - b) / 2)


def downmix(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: (a + b) / 2)


def zeros(n: Column | int) -> Column:
    return F.array_repeat(F.lit(0.0), F.lit(n) if isinstance(n, int) else n)


def excerpt_rms_db(x: Column, start: Column, length: Column | int) -> Column:
    """Level of a stretch of a signal; start from 0."""
    return rms_db(F.slice(x, start + 1, length))


def delay_right(left: Column, right: Column, samples: Column) -> tuple[Column, Column]:
    return F.concat(left, zeros(samples)), F.concat(zeros(samples), right)


def fractional_delay(x: Column, delay: Column) -> Column:
    """Linear interpolation between neighbours; the result is longer by the whole part of the delay."""
    whole, part = F.floor(delay).cast("int"), delay - F.floor(delay)
    before = F.concat(F.array(F.lit(0.0)), F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))))
    return F.concat(zeros(whole), F.zip_with(x, before, lambda now, last: (1 - part) * now + part * last))


def mix(signals: Column) -> Column:
    """Sum of array<array<double>>, each padded to the longest."""
    longest = F.array_max(F.transform(signals, F.size))
    return F.aggregate(signals, F.array_repeat(F.lit(0.0), longest), lambda s, x: F.zip_with(s, x, lambda a, b: a + F.coalesce(b, F.lit(0.0))))


def window_starts(samples: Column, length: Column | int) -> Column:
    """0-based starts of whole windows; a partial tail is left out."""
    length = F.lit(length) if isinstance(length, int) else length
    return F.when(samples >= length, F.sequence(F.lit(0), samples - length, length)).otherwise(F.array().cast("array<int>"))


def greedy_matches(true: Column, predicted: Column, tolerance: float) -> Column:
    """How many true values find a prediction, each taking the first one left within the tolerance; in order, not optimal."""
    start = F.struct(F.lit(0).alias("n"), predicted.alias("left"))

    def take(s: Column, t: Column) -> Column:
        at = F.array_position(F.transform(s["left"], lambda p: F.abs(p - t) <= tolerance), F.lit(True)).cast("int")
        rest = F.filter(s["left"], lambda _, i: i != at - 1)
        return F.when(at > 0, F.struct((s["n"] + 1).alias("n"), rest.alias("left"))).otherwise(s)

    return F.aggregate(true, start, take, lambda s: s["n"])


def local_maxima(density: Column) -> Column:
    """0-based positions with a value at least that on the left and above that on the right; ends count as well."""
    n = F.size(density)

    def at(i: Column) -> Column:
        return F.element_at(density, i + 1)

    return F.filter(F.sequence(F.lit(0), n - 1), lambda i: ((i == 0) | (at(i) >= at(F.greatest(i - 1, F.lit(0))))) & ((i == n - 1) | (at(i) > at(F.least(i + 1, n - 1)))))


def thinned(peaks: Column, separation: float) -> Column:
    """array<struct<height, x>>, tallest first, without those nearer than the separation to a taller one; by x."""
    tall = F.array_sort(peaks, lambda a, b: F.when(a["height"] > b["height"], -1).when(a["height"] < b["height"], 1).when(a["x"] < b["x"], -1).otherwise(1))
    kept = F.aggregate(tall, F.slice(tall, 1, 0), lambda k, p: F.when(F.exists(k, lambda q: F.abs(q["x"] - p["x"]) < separation), k).otherwise(F.concat(k, F.array(p))))
    return F.array_sort(kept, lambda a, b: F.when(a["x"] < b["x"], -1).when(a["x"] > b["x"], 1).otherwise(0))
