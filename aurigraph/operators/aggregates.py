"""Aggregates whose partial states merge: weighted medians as sorted runs, and sketches of answers that are stored and merged.

A run is a pair of arrays, ascending values and the weight of each; a task makes one of its own rows for each group, with equal values
added up, so a group moves as runs and not as rows. The median of a group is read from its merged runs: by cue_weighted_median, which holds
a group's runs in one task, or by medians_of_runs, which adds them up where Spark puts them and holds none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.types import ArrayType, DoubleType, Row, StringType, StructField, StructType

from ..sources.shared import stored

#: Values that a task holds for all its groups before it hands on their runs.
HELD = 1 << 18
#: Parts that a value grows through to e times itself; medians_of_runs sorts the values of one part of a group.
PARTS = 256
RUN = "values array<double>, weights array<double>"


def compact(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending values without nulls and weights above 0 only, equal values once; NaN comes last."""
    fine = weights > 0
    found, at = np.unique(values[fine], return_inverse=True)
    return found, np.bincount(at, weights[fine], len(found)) if len(found) else np.zeros(0)


def middle(values: np.ndarray, weights: np.ndarray) -> float | None:
    """The least value up to which half of the weight lies; None without any."""
    values, weights = compact(values, weights)
    if not len(values):
        return None
    total = np.cumsum(weights)
    return float(values[np.searchsorted(total, total[-1] / 2)])


class _Held:
    """What a task has seen of each group."""

    def __init__(self):
        self.groups: dict[object, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.size = 0

    def add(self, key: object, values: np.ndarray, weights: np.ndarray) -> None:
        self.groups.setdefault(key, []).append((values, weights))
        self.size += len(values)

    def runs(self) -> Iterator[tuple[object, np.ndarray, np.ndarray]]:
        for key, parts in self.groups.items():
            yield key, *compact(np.concatenate([v for v, _ in parts]), np.concatenate([w for _, w in parts]))
        self.groups, self.size = {}, 0


def runs(df: DataFrame, by: str, value: str, weight: str) -> DataFrame:
    """(by, values, weights): the runs of each task's groups. Rows without a value or a weight are left out."""
    plain = df.select(by, F.col(value).cast("double").alias("v"), F.col(weight).cast("double").alias("w")).filter("v IS NOT NULL AND w IS NOT NULL")
    kind = pa.schema([("values", pa.list_(pa.float64())), ("weights", pa.list_(pa.float64()))])

    def made(held: _Held, key: pa.DataType) -> pa.RecordBatch:
        found = list(held.runs())
        return pa.RecordBatch.from_arrays([pa.array([k for k, *_ in found], key), pa.array([v for _, v, _ in found], kind.types[0]), pa.array([w for *_, w in found], kind.types[1])], names=[by, "values", "weights"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = _Held(), None
        for batch in batches:
            key = batch.schema.field(by).type
            codes = batch.column(by).dictionary_encode(null_encoding="encode")
            at, v, w = np.asarray(codes.indices), batch.column("v").to_numpy(), batch.column("w").to_numpy()
            for i, name in enumerate(codes.dictionary.to_pylist()):
                held.add(name, v[at == i], w[at == i])
            if held.size > HELD:
                yield made(held, key)
        if held.size:
            yield made(held, key)

    return plain.mapInArrow(work, f"{by} {df.schema[by].dataType.simpleString()}, {RUN}")


@pandas_udf(DoubleType())
def cue_weighted_median(values: pd.Series, weights: pd.Series) -> float:
    if not len(values):
        return None
    flat = lambda s: np.concatenate([np.atleast_1d(np.asarray(x, float)) for x in s])
    v, w = flat(values), flat(weights)
    return middle(v, np.where(np.isnan(w), 0.0, w))


@udtf(returnType=StructType([StructField("k", StringType()), StructField("values", ArrayType(DoubleType())), StructField("weights", ArrayType(DoubleType()))]))
class CueRuns:
    """cue_runs(TABLE(SELECT key, value, weight ...)): the runs of each task's groups, keys as text."""

    def __init__(self):
        self.held: dict[str | None, dict[float, float]] = {}
        self.size = 0

    def eval(self, row: Row):
        key, value, weight = row
        if value is not None and weight is not None and weight > 0:
            own = self.held.setdefault(None if key is None else str(key), {})
            self.size += float(value) not in own
            own[float(value)] = own.get(float(value), 0.0) + float(weight)
            if self.size > HELD:
                yield from self.terminate()

    def terminate(self):
        for key, own in self.held.items():
            found = sorted(own)
            yield key, found, [own[v] for v in found]
        self.held, self.size = {}, 0


def register(spark: SparkSession) -> None:
    """Make cue_weighted_median callable in GROUP BY, over values and weights or over the runs of the table function cue_runs."""
    spark.udf.register("cue_weighted_median", cue_weighted_median)
    spark.udtf.register("cue_runs", CueRuns)


def medians_of_runs(runs: DataFrame, by: str) -> DataFrame:
    """(by, median) of (by, values, weights), as cue_weighted_median gives it, for groups of any size.

    The weights of a value are added up by group and value, and these sums by parts of the values; the part in which half of the weight is
    reached is the only one that is sorted. A group without weight has a null median.
    """
    each = runs.select(F.col(by).alias("k"), F.explode_outer(F.arrays_zip(F.col("values").alias("v"), F.col("weights").alias("w"))).alias("r")).select("k", "r.v", "r.w")
    heavy = (F.col("w") > 0) & ~F.isnan("w")
    summed = each.select("k", F.when(heavy, F.col("v")).alias("v"), F.when(heavy, F.col("w")).otherwise(0.0).alias("w")).groupBy("k", "v").agg(F.sum("w").alias("w"))
    part = F.when(F.isnan("v"), F.lit((1 << 63) - 1)).otherwise(F.floor(F.signum("v") * F.log1p(F.abs("v")) * PARTS))
    sums = stored(summed.withColumn("part", part), "weighted-values")
    so_far, whole = Window.partitionBy("k").orderBy("part"), Window.partitionBy("k")
    parts = sums.groupBy("k", "part").agg(F.sum("w").alias("w")).withColumns({"upto": F.sum("w").over(so_far), "half": F.sum("w").over(whole) / 2})
    there = parts.filter("upto >= half").groupBy("k").agg(F.min(F.struct("part", (F.col("upto") - F.col("w")).alias("below"), "half")).alias("r")).select(F.col("k").alias("group"), F.col("r.part").alias("at"), "r.below", "r.half")
    met = sums.join(there, F.col("k").eqNullSafe(F.col("group")) & F.col("part").eqNullSafe(F.col("at")))
    reached = F.col("below") + F.sum("w").over(Window.partitionBy("k").orderBy("v")) >= F.col("half")
    found = met.withColumn("reached", reached).groupBy("k").agg(F.coalesce(F.min(F.when(F.col("reached"), F.col("v"))), F.max("v")).alias("m"))
    return found.select(F.col("k").alias(by), F.when(~F.isnan("m"), F.col("m")).alias("median"))


def weighted_median(df: DataFrame, by: str, value: str, weight: str) -> DataFrame:
    """(by, median): the least value of each group up to which half of its weight lies. Weights of 0 and less count for nothing; NaN
    is above all numbers. The median is null where it is NaN, and in a group without any weight that has a value."""
    return medians_of_runs(runs(df, by, value, weight), by)


#: Fixed by the size of the sketches: relative error of a count, and of a rank.
COUNT_ERROR, RANK_ERROR = 0.02, 0.015
#: log2 of the registers of a count sketch; the size of a rank sketch.
HLL, KLL = 14, 300


def sketched(answers: DataFrame, answer: str, *by: str) -> DataFrame:
    """(by, n, answers, ranks): mergeable states of each group's answers: how many, which different ones, and how they are distributed.
    Stored by build or day, they are merged for any span instead of being counted anew."""
    x = F.col(answer).cast("double")
    kept = answers.filter(x.isNotNull() & ~F.isnan(x))
    return kept.groupBy(*by).agg(F.count("*").alias("n"), F.hll_sketch_agg(x.cast("string"), HLL).alias("answers"), F.kll_sketch_agg_double(x, KLL).alias("ranks"))


def merged(states: DataFrame, *by: str) -> DataFrame:
    """The states of coarser groups; in any order and any number of steps."""
    return states.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("answers").alias("answers"), F.kll_merge_agg_double("ranks").alias("ranks"))


def distinct_answers(states: Column | str = "answers") -> Column:
    """About how many different answers a state has seen, within COUNT_ERROR."""
    return F.hll_sketch_estimate(states)


def answer_quantile(share: float, states: Column | str = "ranks") -> Column:
    """An answer whose rank is within RANK_ERROR of the share."""
    return F.kll_sketch_get_quantile_double(states, F.lit(share))


def answers_below(value: Column, states: Column | str = "ranks") -> Column:
    """About which share of the answers is at most the value, within RANK_ERROR."""
    return F.kll_sketch_get_rank_double(states, value)
