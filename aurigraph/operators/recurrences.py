"""Recurrences along signals of any length: running sums, second-order filters, compressors.

A signal is cut into stretches, one row each: (key, stretch, x), x being an array. A linear recurrence maps the state before a stretch
to the one after it by an affine map, whose matrix depends on the stretch's length only and whose offset is the state that the stretch
ends in when it starts from rest. All stretches run from rest at once; the maps are composed along the key, two numbers a stretch; and
what the state at its start adds to a stretch is a response that fades out. A compressor isn't linear, as it rises and falls at different
speeds; its stretches run from the states that are known so far until none of them changes, and as the state is forgotten along a
stretch, that takes few rounds. The result doesn't depend on where a signal is cut, but for rounding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

STRETCH = 4096


def cut(signals: DataFrame, key: str, x: str, stretch: int = STRETCH) -> DataFrame:
    """(key, stretch, x): each row's signal in stretches of so many samples."""
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(x) / stretch) - 1, F.lit(0)).cast("int")), lambda k: F.slice(F.col(x), k * stretch + 1, stretch))
    return signals.select(key, F.posexplode(pieces).alias("stretch", "x"))


def running_sum(samples: DataFrame, key: str, pos: str, value: str, stretch: int = STRETCH) -> DataFrame:
    """(key, pos, total) of samples, a row each: the sum of the values up to each position. A stretch of positions is one task's, and
    the sums of stretches, a row each, are carried along the key."""
    rows = samples.select(key, pos, F.col(value).alias("v"), F.floor(F.col(pos) / stretch).alias("stretch"))
    own = F.sum("v").over(Window.partitionBy(key, "stretch").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0))
    before = F.sum("all").over(Window.partitionBy(key).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
    carried = rows.groupBy(key, "stretch").agg(F.sum("v").alias("all")).select(key, "stretch", F.coalesce(before, F.lit(0.0)).alias("before"))
    return rows.withColumn("own", own).join(carried, [key, "stretch"]).select(key, pos, (F.col("own") + F.col("before")).alias("total"))


def _padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows x longest, lengths)."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out, lengths


def _listed(rows: np.ndarray, lengths: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rows[np.arange(rows.shape[1]) < lengths[:, None]]))


def second_order(x: np.ndarray, lengths: np.ndarray, c: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(y, states at the rows' ends) of b0, b1, b2, a1, a2 in each row of c; the state holds the two numbers that the next sample needs."""
    y, (p, q), end = np.zeros_like(x), state.T.copy(), state.copy()
    b0, b1, b2, a1, a2 = c.T
    for t in range(x.shape[1]):
        now = b0 * x[:, t] + p
        p, q = b1 * x[:, t] - a1 * now + q, b2 * x[:, t] - a2 * now
        y[:, t] = now
        last = lengths == t + 1
        end[last, 0], end[last, 1] = p[last], q[last]
    return y, end


def _kept(stretches: DataFrame, key: str) -> str:
    return f"{key} {stretches.schema[key].dataType.simpleString()}, stretch int"


def biquad(stretches: DataFrame, key: str, coefficients: str = "c") -> DataFrame:
    """(key, stretch, y): stretches (key, stretch, x, c) filtered by the normalised coefficients c, an array b0, b1, b2, a1, a2 that is the
    same for all stretches of a key. Stretches count from 0 without gaps."""
    plain = stretches.select(key, F.col("stretch").cast("int").alias("stretch"), F.col("x").cast("array<double>").alias("x"), F.col(coefficients).cast("array<double>").alias("c"))

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, n = _padded(batch.column("x"))
            _, end = second_order(x, n, np.array(batch.column("c").to_pylist()).reshape(len(n), 5), np.zeros((len(n), 2)))
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("stretch"), pa.array(n), batch.column("c"), pa.array(end.tolist(), pa.list_(pa.float64()))], names=[key, "stretch", "n", "c", "end"])

    ends = plain.mapInArrow(rest, _kept(stretches, key) + ", n long, c array<double>, end array<double>")
    chains = ends.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("stretch", "n", "c", "end"))).alias("chain"))  # a few numbers a stretch

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, numbers, states = [], [], []
            for name, chain in zip(batch.column(key).to_pylist(), batch.column("chain").to_pylist(), strict=True):
                now, powers = np.zeros(2), {}
                for link in chain:
                    keys.append(name)
                    numbers.append(link["stretch"])
                    states.append(now.tolist())
                    if (n := link["n"]) not in powers:
                        a1, a2 = link["c"][3:]
                        powers[n] = np.linalg.matrix_power(np.array([[-a1, 1.0], [-a2, 0.0]]), n)
                    now = powers[n] @ now + link["end"]
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(key).type), pa.array(numbers, pa.int32()), pa.array(states, pa.list_(pa.float64()))], names=[key, "stretch", "state"])

    starts = chains.mapInArrow(carry, _kept(stretches, key) + ", state array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, n = _padded(batch.column("x"))
            y, _ = second_order(x, n, np.array(batch.column("c").to_pylist()).reshape(len(n), 5), np.array(batch.column("state").to_pylist()).reshape(len(n), 2))
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("stretch"), _listed(y, n)], names=[key, "stretch", "y"])

    return plain.join(starts, [key, "stretch"]).select(key, "stretch", "x", "c", "state").mapInArrow(run, _kept(stretches, key) + ", y array<double>")


def follow(target: np.ndarray, lengths: np.ndarray, state: np.ndarray, attack: float, release: float) -> tuple[np.ndarray, np.ndarray]:
    """(y, states at the rows' ends) of a one-pole follower that rises with one coefficient and falls with another."""
    y, now, end = np.zeros_like(target), state.copy(), state.copy()
    for t in range(target.shape[1]):
        c = np.where(target[:, t] > now, attack, release)
        now = c * now + (1 - c) * target[:, t]
        y[:, t] = now
        last = lengths == t + 1
        end[last] = now[last]
    return y, end


def compressor(stretches: DataFrame, key: str, threshold: float, ratio: float, attack: float, release: float, most_rounds: int = 1000) -> DataFrame:
    """(key, stretch, y): the smoothed gain reduction in dB over stretches (key, stretch, x) of levels. Rounds end when no stretch would
    start from another state than it did; the stretch after one that is right is right a round later, so they always do."""
    plain = stretches.select(key, F.col("stretch").cast("int").alias("stretch"), F.col("x").cast("array<double>").alias("x"))

    def ran(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, n = _padded(batch.column("x"))
            y, end = follow(np.maximum(x - threshold, 0.0) * (1 - 1 / ratio), n, batch.column("state").to_numpy(zero_copy_only=False), attack, release)
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("stretch"), pa.array(end), _listed(y, n)], names=[key, "stretch", "end", "y"])

    states = plain.select(key, "stretch", F.lit(0.0).alias("state"))
    for _ in range(most_rounds):
        done = plain.join(states, [key, "stretch"]).mapInArrow(ran, _kept(stretches, key) + ", end double, y array<double>")
        before = F.coalesce(F.lag("end").over(Window.partitionBy(key).orderBy("stretch")), F.lit(0.0))
        ends = done.select(key, "stretch", before.alias("next")).join(states, [key, "stretch"])
        told = stored(ends.select(key, "stretch", F.col("next").alias("state"), (F.col("next") != F.col("state")).alias("changed")), "compressor-states")
        if told.filter("changed").isEmpty():
            return done.select(key, "stretch", "y")
        states = told.select(key, "stretch", "state")
    raise RuntimeError(f"states still changed after {most_rounds} rounds")


def whole(stretches: DataFrame, key: str, y: str = "y") -> DataFrame:
    """(key, y): stretches put together again, for signals that fit a row."""
    ordered = F.array_sort(F.collect_list(F.struct("stretch", F.col(y).alias("y"))))
    return stretches.groupBy(key).agg(F.flatten(F.transform(ordered, lambda s: s["y"])).alias(y))
