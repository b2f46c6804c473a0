"""Joins by nearness: in time, by value and within a tolerance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_in_time(targets: DataFrame, frames: DataFrame, key: str, time: str, values: list[str], tolerance: float, bucket: float | None = None) -> DataFrame:
    """targets with the values of the frame nearest in time (ties: the earlier), null beyond the tolerance.

    Both sides are stacked. The last frame at or before a target is a running value over the ascending order of (key, time), the first
    one after it over the descending order, so no pair is made and each sort is read once. Frames of equal time: the first by its
    values counts. With `bucket` a key is cut into stretches of so much time, each sorted by itself, and the frames at their ends,
    one row a stretch, are carried over; for keys that hold too many rows for one task.
    """
    frame = F.struct(F.col(time).alias("at"), *values)
    once = frames.groupBy(key, time).agg(F.min(frame).alias("frame"))
    stacked = once.select(key, F.col(time).alias("__t"), F.lit(0).alias("__side"), "frame", F.lit(None).cast(targets.select(F.struct("*")).schema[0].dataType).alias("target"))
    asked = targets.select(key, F.col(time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(once.schema["frame"].dataType).alias("frame"), F.struct("*").alias("target"))
    both, parts = stacked.unionByName(asked), [key]
    if bucket is not None:
        both, parts = both.withColumn("__b", F.floor(F.col("__t") / bucket)), [key, "__b"]
    run = Window.partitionBy(*parts)
    last = F.last("frame", ignorenulls=True)
    both = both.withColumn("before", last.over(run.orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("after", last.over(run.orderBy(F.desc("__t"), "__side").rowsBetween(Window.unboundedPreceding, 0)))
    if bucket is not None:
        ends = both.groupBy(*parts).agg(F.min("frame").alias("first"), F.max("frame").alias("last"))
        steps = Window.partitionBy(key)
        carried = ends.select(
            *parts,
            F.last("last", ignorenulls=True).over(steps.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"),
            F.last("first", ignorenulls=True).over(steps.orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)).alias("later"),
        )
        both = both.filter("target IS NOT NULL").join(carried, parts, "left").withColumns({"before": F.coalesce("before", "earlier"), "after": F.coalesce("after", "later")})
    back, ahead = F.col("__t") - F.col("before.at"), F.col("after.at") - F.col("__t")
    chosen = F.when(ahead.isNull() | (back <= ahead), F.struct(back.alias("d"), F.col("before").alias("f"))).otherwise(F.struct(ahead.alias("d"), F.col("after").alias("f")))
    found = both.filter("target IS NOT NULL").withColumn("n", chosen)
    hit = F.col("n.d") <= tolerance
    return found.select("target.*", *[F.when(hit, F.col(f"n.f.{v}")).alias(f"nearest_{v}") for v in values])


def compare_pitch(aligned: DataFrame, estimated: str, reference: str, tolerance: float = 0.03, *by: str) -> DataFrame:
    """Estimated f0 (null: unvoiced) against a reference (0: unvoiced) by frames: errors where both are voiced, in percent, the share
    within the tolerance, and how often the two agree on voicing."""
    sung, found = F.col(reference) > 0, F.col(estimated).isNotNull() & ~F.isnan(estimated)
    error = F.when(sung & found, F.abs(F.col(estimated) - F.col(reference)) / F.col(reference))
    return aligned.groupBy(*by).agg(
        F.count("*").alias("frames"), F.count(error).alias("compared"), F.count_if(sung).alias("reference_voiced"), F.median(error * 100).alias("median_error"), F.avg(error * 100).alias("mean_error"),
        F.avg((error <= tolerance).cast("double")).alias("within"), F.avg((sung == found).cast("double")).alias("voicing_agreement"),
    )


def nearest_value(rows: DataFrame, value: str, candidates: list[float]) -> DataFrame:
    """rows with `snapped`: the candidate nearest to the value, ties to the first in order. Candidates are a few literals."""
    options = F.array(*[F.struct(F.abs(F.col(value) - c).alias("d"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(sorted(candidates))])
    return rows.withColumn("snapped", F.array_min(options)["c"])


def within(value, candidates: list[float], tolerance: float):
    """Whether any candidate is within the tolerance; null for null."""
    return F.exists(F.array(*map(F.lit, candidates)), lambda c: F.abs(value - c) <= tolerance)


#: Levels of the dyadic decomposition: cells are numbered from -2**(LEVELS - 1) to 2**(LEVELS - 1).
LEVELS = 52


def _cell(value: Column, unit: float) -> Column:
    """The number of the value's cell from 0 on; values beyond all cells count as in the last one on their side, NaN as above all."""
    most = float(1 << (LEVELS - 1))
    cell = F.floor(F.greatest(F.least(value.cast("double") / unit, F.lit(most - 1)), F.lit(-most))).cast("long")
    return F.when(F.isnan(value.cast("double")), F.lit((1 << LEVELS) - 1)).when(value.isNotNull(), cell + (1 << (LEVELS - 1)))


def dyadic(first: Column, last: Column) -> Column:
    """array<struct<level, block>>: the cells first to last (both included) as the fewest blocks of 2**level aligned cells.

    At a level there is at most one block at either end: where the start, rounded up, is odd, and where the end, rounded down, is.
    """

    def ends(k: Column) -> Column:
        left = F.call_function("shiftright", first + F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1, k)
        right = F.call_function("shiftright", last + 1, k)
        one = lambda at, block: F.when((left < right) & (at % 2 == 1), F.struct(k.alias("level"), block.alias("block")))
        return F.filter(F.array(one(left, left), one(right, right - 1)), lambda b: b.isNotNull())

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), ends))


def in_ranges(points: DataFrame, ranges: DataFrame, value: str, low: str, high: str, unit: float) -> DataFrame:
    """points joined with the ranges [low, high] that hold them; a null end is open, an empty range holds nothing.

    The line is cut into cells of `unit`. A range becomes at most two aligned blocks a level, so 2 * log2(its cells) rows however
    long it is; a point looks up the one block of each level that the ranges use, by equality. The unit decides how much the exact
    comparison at the ends has to sort out, never what is found. Null values are in no range; NaN is above all numbers.
    """
    names = {c.lower() for c in (*points.columns, *ranges.columns)}
    level, block, span = (next(n for n in (base + "_" * i for i in range(1, 99)) if n.lower() not in names) for base in ("level", "block", "span"))
    lowest, highest = F.coalesce(_cell(F.col(low), unit), F.lit(0).cast("long")), F.coalesce(_cell(F.col(high), unit), F.lit((1 << LEVELS) - 1))
    cut = ranges.filter(F.coalesce(F.col(low) <= F.col(high), F.lit(True))).withColumn(span, F.explode(dyadic(lowest, highest)))
    cut = cut.withColumn(level, F.col(span)["level"]).withColumn(block, F.col(span)["block"]).drop(span)
    used = sorted(r[0] for r in cut.select(level).distinct().collect())  # LEVELS + 1 at most
    if not used:
        return points.join(ranges.limit(0), F.lit(False))
    asked = points.filter(F.col(value).isNotNull()).withColumn(level, F.explode(F.array(*map(F.lit, used))))
    asked = asked.withColumn(block, F.call_function("shiftright", _cell(F.col(value), unit), F.col(level)))
    met = asked.join(cut, [level, block])
    held = F.coalesce(F.col(value) >= F.col(low), F.lit(True)) & F.coalesce(F.col(value) <= F.col(high), F.lit(True))
    return met.filter(held).drop(level, block)


def totals_in_ranges(points: DataFrame, ranges: DataFrame, by: str, value: str, low: str, high: str, unit: float, totals: dict[str, tuple[str, str]]) -> DataFrame:
    """(by, *totals): what a groupBy(by) of in_ranges() gives, without a row for each pair, of which there may be as many as points times ranges.

    totals: name -> (count, sum, min or max; column of points). Points are added up by value and then by block; a range takes the totals of
    the few blocks between its ends, and of the values in the two cells at its ends those that an exact comparison finds inside. A range
    that holds nothing has no row.
    """
    merge = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
    merged = [merge[kind](f"t.{name}").alias(name) for name, (kind, _) in totals.items()]
    own = [F.count(F.lit(1) if c == "*" else c).alias(name) if kind == "count" else merge[kind](c).alias(name) for name, (kind, c) in totals.items()]
    values = points.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(*own).select("v", _cell(F.col("v"), unit).alias("cell"), F.struct(*totals).alias("t"))
    first, last = F.coalesce(_cell(F.col(low), unit), F.lit(0).cast("long")), F.coalesce(_cell(F.col(high), unit), F.lit((1 << LEVELS) - 1))
    held = ranges.filter(F.coalesce(F.col(low) <= F.col(high), F.lit(True))).select(F.col(by).alias("by"), F.col(low).alias("low"), F.col(high).alias("high"), first.alias("first"), last.alias("last"))
    ends = held.withColumn("cell", F.explode(F.array_distinct(F.array("first", "last")))).join(values, "cell")
    exact = ends.filter(F.coalesce(F.col("v") >= F.col("low"), F.lit(True)) & F.coalesce(F.col("v") <= F.col("high"), F.lit(True))).select("by", "t")
    inner = held.filter("first + 1 < last").select("by", F.explode(dyadic(F.col("first") + 1, F.col("last") - 1)).alias("b")).select("by", "b.level", "b.block")
    used = sorted(r[0] for r in inner.select("level").distinct().collect())  # LEVELS + 1 at most
    if used:
        blocks = values.select(F.explode(F.array(*map(F.lit, used))).alias("level"), "cell", "t").groupBy("level", F.call_function("shiftright", F.col("cell"), F.col("level")).alias("block")).agg(F.struct(*merged).alias("t"))
        exact = exact.unionByName(inner.join(blocks, ["level", "block"]).select("by", "t"))
    return exact.groupBy(F.col("by").alias(by)).agg(*merged)
