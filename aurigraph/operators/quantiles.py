"""Exact quantiles of any number of rows, by selection in passes: no task holds more of a group than `limit` rows.

Groups that are small from the start are aggregated directly. For the ranks of a larger group a pass asks a mergeable sketch for GRID
values that cut it up evenly, takes two of them so far on either side of the rank that the sketch's error can't matter, counts exactly
what lies below and between, and goes on with what lies strictly between: about a 300th of the rows. When that is within the limit it is put in
order. The sketch only decides how fast the passes narrow.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

#: The sketch errs by one rank in ACCURACY at most, less than a cell of the grid.
ACCURACY, GRID = 10_000, 1_000
LIMIT = 100_000
MOST_PASSES = 12
#: Open ranks that are broadcast at most.
BROADCAST_ROWS = 100_000


def _meet(numbers: DataFrame, ranks: DataFrame) -> DataFrame:
    """Values with the open ranks of their group, as far as these still look at them."""
    few = F.broadcast(ranks) if ranks.count() <= BROADCAST_ROWS else ranks
    above = F.col("lo").isNull() | (F.col("v") > F.col("lo"))
    below = F.col("hi").isNull() | (F.col("v") < F.col("hi"))
    return numbers.join(few, "g").filter(above & below)


def _in_order(values: DataFrame) -> DataFrame:
    """(g, r, x): the value at `want` of each (g, r); values: (g, r, want, v). Equal values are counted first."""
    counted = values.groupBy("g", "r", "want", "v").count()
    past = F.sum("count").over(Window.partitionBy("g", "r").orderBy("v"))
    return counted.withColumn("past", past).filter("past - count <= want AND want < past").select("g", "r", F.col("v").alias("x"))


def ranked(numbers: DataFrame, ranks: DataFrame, limit: int = LIMIT, accuracy: int = ACCURACY, grid: int = GRID) -> DataFrame:
    """(g, r, x): the r-th least value, from 0, of each group. numbers: (g, v) without nulls and NaN; ranks: (g, r, m), m being the number of the group's values."""
    found = []
    open_ = ranks.select("g", "r", F.col("r").alias("want"), "m", F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))
    for _ in range(MOST_PASSES):
        last, more = open_.filter(F.col("m") <= limit), open_.filter(F.col("m") > limit)
        found.append(_in_order(_meet(numbers, last).select("g", "r", "want", "v")))
        if more.isEmpty():
            return reduce(DataFrame.unionByName, found)
        cells = F.percentile_approx("v", F.array(*[F.lit(i / grid) for i in range(grid + 1)]), accuracy)
        cuts = stored(_meet(numbers, more).groupBy("g", "r", "want", "m", "lo", "hi").agg(cells.alias("cuts")), "quantile-cuts")
        at = F.floor(F.col("want") / F.col("m") * grid).cast("int")
        low = F.when(at - 1 > 0, F.element_at("cuts", F.greatest(at, F.lit(1)))).otherwise(F.col("lo"))
        high = F.when(at + 2 < grid, F.element_at("cuts", F.least(at + 3, F.lit(grid + 1)))).otherwise(F.col("hi"))
        near = cuts.select("g", "r", "want", "lo", "hi", low.alias("a"), high.alias("b"))
        a, b, v = F.col("a"), F.col("b"), F.col("v")
        inside = (a.isNull() | (v > a)) & (b.isNull() | (v < b))
        counts = [F.count_if(c).alias(n) for n, c in (("below", v < a), ("at_a", v == a), ("m", inside), ("at_b", v == b))]
        counted = stored(_meet(numbers, near).groupBy("g", "r", "want", "a", "b").agg(*counts), "quantile-ranks").withColumn("want", F.col("want") - F.col("below"))
        if not counted.filter("want < 0 OR want >= at_a + m + at_b").isEmpty():
            raise RuntimeError("the sketch erred by more than it may")
        found.append(counted.filter("want < at_a").select("g", "r", a.alias("x")))
        found.append(counted.filter("want >= at_a + m").select("g", "r", b.alias("x")))
        open_ = counted.filter("want >= at_a AND want < at_a + m").select("g", "r", (F.col("want") - F.col("at_a")).alias("want"), "m", a.alias("lo"), b.alias("hi"))
    raise RuntimeError(f"ranks were open after {MOST_PASSES} passes")


def quantiles(df: DataFrame, value: str, at: dict[str, float], *by: str, limit: int = LIMIT) -> DataFrame:
    """A row for each group of `by` (one row without any) with a column for each name of `at`: the quantile of that share, linear between
    neighbouring ranks. Nulls are left out, NaN is above all numbers, a group without values has nulls; null keys are a group.
    """
    rows = stored(df.select(F.struct(F.lit(0).alias("all"), *by).alias("g"), F.col(value).cast("double").alias("v")), "quantile-numbers")  # read in each pass
    counts = rows.groupBy("g").agg(F.count("v").alias("n"), F.count_if(~F.isnan("v") & F.col("v").isNotNull()).alias("m"))
    counts = stored(counts, "quantile-counts")
    shares = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p")) for name, p in at.items()]))
    places = counts.filter("n > 0").select("g", "n", "m", shares.alias("s")).withColumn("k", F.col("s.p") * (F.col("n") - 1))
    places = places.select("g", "m", F.col("s.name").alias("name"), F.floor("k").alias("low"), F.ceil("k").alias("high"), (F.col("k") - F.floor("k")).alias("part"))
    ranks = places.select("g", "m", F.explode(F.array("low", "high")).alias("r")).distinct()
    known = ranked(rows.filter(F.col("v").isNotNull() & ~F.isnan("v")), ranks.filter("r < m"), limit)
    known = known.unionByName(ranks.filter("r >= m").select("g", "r", F.lit(float("nan")).alias("x")))

    def x(name: str) -> DataFrame:
        return known.select("g", F.col("r").alias(name), F.col("x").alias(f"x_{name}"))

    both = places.join(x("low"), ["g", "low"]).join(x("high"), ["g", "high"])
    between = F.when(F.col("x_low") == F.col("x_high"), F.col("x_low")).otherwise(F.col("x_low") + F.col("part") * (F.col("x_high") - F.col("x_low")))
    wide = both.groupBy("g").agg(*[F.max(F.when(F.col("name") == name, between)).alias(name) for name in at])
    named = counts.select("g").join(wide, "g", "left").select(*[F.col("g")[b].alias(b) for b in by], *at)
    return named if by else rows.sparkSession.range(1).select(F.struct(F.lit(0).alias("all")).alias("g")).join(wide, "g", "left").select(*at)


def median(df: DataFrame, value: str, *by: str, limit: int = LIMIT) -> DataFrame:
    return quantiles(df, value, {"median": 0.5}, *by, limit=limit)
