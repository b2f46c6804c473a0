"""Numbers as text, rounded half to even on the exact binary value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(x: Column, places: int) -> Column:
    return F.regexp_replace(F.format_number(x.cast("double"), places), ",", "")


def general(x: Column) -> Column:
    """Six significant digits without trailing zeros, for magnitudes from 1e-4 to 1e6."""
    x = x.cast("double")
    places = F.when(x == 0, 0).otherwise(F.greatest(F.lit(0), 5 - F.floor(F.log10(F.abs(x))))).cast("int")
    text = F.regexp_replace(F.call_function("format_number", x, places), ",", "")
    return F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)


def angle_label(x: Column) -> Column:
    """+g with p for + and neg for -."""
    return F.concat(F.when(x < 0, "neg").otherwise("p"), general(F.abs(x)))


def step_label(step: Column) -> Column:
    """kind_keyvalue_..., keys in order, p for the point and neg for minus."""
    pairs = F.transform(F.array_sort(F.map_entries(step["params"])), lambda e: F.concat(e["key"], F.replace(F.replace(general(e["value"]), F.lit("."), F.lit("p")), F.lit("-"), F.lit("neg"))))
    return F.concat_ws("_", step["kind"], F.array_join(pairs, "_"))


def processing_label(steps: Column) -> Column:
    return F.when(F.size(steps) == 0, "dry").otherwise(F.array_join(F.transform(steps, step_label), "_"))
