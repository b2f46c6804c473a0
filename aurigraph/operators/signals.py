"""Signal operators: Arrow-batched wrappers of the NumPy kernels, and the ridge probe by sufficient statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dsp

MEASURES = ("ild_db", "high_frequency_ild_db", "ild_flatness_db", "itd_us", "itd_peak_strength", "coherence", "estimated_azimuth_deg", "binaural_azimuth_deg", "f0_hz")
#: Bytes that a task takes from Spark and hands back at once: signals are long, and a batch of 10,000 rows of them is gigabytes.
PART_BYTES = 4 << 20
_KINDS = {m: "double" for m in MEASURES} | {"active_bins": "int", "estimated_regime": "string", "problem": "string"}
_MEASURED = ", ".join(f"{m} {kind}" for m, kind in _KINDS.items())


def _cells(column: pa.Array) -> list:
    """The values of a column; arrays of numbers as views of the column's own buffer."""
    if pa.types.is_list(column.type) and pa.types.is_floating(column.type.value_type) and not column.null_count:
        values, ends = column.values, column.offsets.to_numpy()
        if not values.null_count:
            whole = values.to_numpy()
            return [whole[a:b] for a, b in zip(ends[:-1], ends[1:])]
    return column.to_pylist()


def _column(values: list, kind: pa.DataType) -> pa.Array:
    if pa.types.is_list(kind) and pa.types.is_floating(kind.value_type) and values and all(isinstance(v, np.ndarray) for v in values):
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(v) for v in values])]), pa.int32()), pa.array(np.concatenate(values).astype(float)))
    return pa.array(values, kind)


def small_batches(spark: SparkSession) -> None:
    """Let Spark hand rows to Python in batches of PART_BYTES, as the corpus operators do."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(PART_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def per_row(df: DataFrame, columns: list[str], keep: list[str], work: Callable[..., dict], schema: str) -> DataFrame:
    """df's `keep` columns and those of work(*columns), one row each, in parts of about PART_BYTES. Arrays of doubles come as NumPy views."""
    small_batches(df.sparkSession)
    kept = df.select(*keep).schema
    names = [part.split()[0] for part in schema.split(", ")]
    full = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept] + [schema])
    kinds = {"double": pa.float64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    types = [kinds[part.split()[1]] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each, start, rows, size = batch.nbytes / max(1, batch.num_rows), 0, [], 0

            def part() -> pa.RecordBatch:
                made = [_column([r.get(n) for r in rows], t) for n, t in zip(names, types)]
                return pa.RecordBatch.from_arrays([*(batch.column(k).slice(start, len(rows)) for k in keep), *made], names=[*keep, *names])

            for values in zip(*(_cells(batch.column(c)) for c in columns)):
                rows.append(row := work(*values))
                size += each + sum(8 * len(v) for v in row.values() if hasattr(v, "__len__"))
                if size >= PART_BYTES:
                    yield part()
                    start, rows, size = start + len(rows), [], 0
            if rows:
                yield part()

    return df.select(*dict.fromkeys([*keep, *columns])).mapInArrow(run, full)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its largest table is too small to be read by as many tasks, while a row takes long; else as it is."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    largest = max((int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())), default=0)
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    size = int(split.rstrip("bB")) if split.rstrip("bB").isdigit() else 128 << 20
    return df if largest >= size * cores else df.repartition(cores)


def _cues(left: np.ndarray, right: np.ndarray, rate: int, f0: tuple[float, float] | None = None, cues: tuple[str, ...] | None = None) -> dict:
    try:
        return dsp.measure(left, right, rate, f0, cues)
    except dsp.Unusable as problem:
        return {"problem": str(problem)}


def measured(df: DataFrame, keep: list[str], rate: int, left: str = "left", right: str = "right", code: str | None = None) -> DataFrame:
    """All cues of each clip, with its pitch where `code` names a column of instrument codes. A clip that can't be measured has
    nulls and says why, as one bad file must not end a survey; an unknown instrument is an error."""

    def work(a: np.ndarray, b: np.ndarray, instrument: str | None = None) -> dict:
        return _cues(np.asarray(a, float), np.asarray(b, float), rate, None if instrument is None else dsp.instrument_range(instrument))

    return per_row(df, [left, right, *([code] if code else [])], keep, work, _MEASURED)


def swept(df: DataFrame, keep: list[str], rate: int, angles: tuple[float, ...], chains: dict[str, list[tuple[str, dict]]], mono: str = "mono", cues: tuple[str, ...] | None = None) -> DataFrame:
    """(keep, chain, azimuth, cues): mono panned to each angle, sent through each chain and measured, a row each, with all cues or those
    named and the problem. A clip is read once, and no signal leaves the task."""
    kinds = {"chain": "string", "azimuth": "double"} | (_KINDS if cues is None else {c: _KINDS[c] for c in (*cues, "problem")})
    floats = {name: [(kind, {k: float(v) for k, v in p.items()}) for kind, p in steps] for name, steps in chains.items()}

    def work(x: np.ndarray) -> dict:
        rows = []
        for chain, azimuth, left, right in dsp.swept(x, rate, tuple(map(float, angles)), floats):
            rows.append({"chain": chain, "azimuth": azimuth} | _cues(left, right, rate, None, cues))
        return {name: [r.get(name) for r in rows] for name in kinds}

    found = per_row(df, [mono], keep, work, ", ".join(f"{name} array<{kind}>" for name, kind in kinds.items()))
    return found.select(*keep, F.inline(F.arrays_zip(*kinds)))


def mixed(df: DataFrame, keep: list[str], monos: str = "monos", azimuths: str = "azimuths") -> DataFrame:
    """df's keep columns with left and right: each signal panned to its azimuth, and all added."""

    def work(signals: list, angles: list) -> dict:
        left, right = (sum(parts) for parts in zip(*(dsp.pan(np.asarray(x, float), a) for x, a in zip(signals, angles, strict=True))))
        return {"left": left, "right": right}

    return per_row(df, [monos, azimuths], keep, work, "left array<double>, right array<double>")


def mix_pitches(df: DataFrame, keep: list[str], rate: int) -> DataFrame:
    """Median f0 and share of voiced frames of a mix, over the range that a mix may have."""
    return pitches(df.withColumn("mono", F.zip_with("left", "right", lambda a, b: (a + b) / 2)), keep, rate, *dsp.MIX_RANGE_HZ)


def noises(df: DataFrame, keep: list[str], samples: int, seed: str) -> DataFrame:
    """df's keep columns with `mono`, white noise seeded by each row's number."""
    return per_row(df, [seed], keep, lambda n: {"mono": np.random.default_rng(int(n)).normal(size=samples) * 0.1}, "mono array<double>")


def noisy_tones(df: DataFrame, keep: list[str], rate: int, seconds: float, f: str, seed: str, share: float = 0.02) -> DataFrame:
    """df's keep columns with `mono`: a tone of each row's frequency in weak noise, or noise alone where that is null."""

    def work(hz: float | None, n: int) -> dict:
        weak = np.random.default_rng(int(n)).normal(size=round(seconds * rate))
        return {"mono": 0.1 * weak if hz is None else dsp.tone(hz, rate, seconds) + share * weak}

    return per_row(df, [f, seed], keep, work, "mono array<double>")


def noisy(df: DataFrame, keep: list[str], azimuth: str, ratio: str, seed: str) -> DataFrame:
    """df's keep columns with left and right: `mono` panned, with noise of its own spectrum on each channel, unlike the other's."""

    def work(mono: np.ndarray, angle: float, share: float, n: int) -> dict:
        rng = np.random.default_rng(int(n))
        left, right = (x + dsp.decorrelated(x, share, rng) for x in dsp.pan(np.asarray(mono, float), angle))
        return {"left": left, "right": right}

    return per_row(df, ["mono", azimuth, ratio, seed], keep, work, "left array<double>, right array<double>")


def pooled_difference(df: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """(key, pos, difference): means of two array columns over a key's rows, position by position, one less the other."""
    rows = df.select(key, F.posexplode(F.arrays_zip(F.col(left).alias("a"), F.col(right).alias("b"))))
    return rows.groupBy(key, "pos").agg((F.avg("col.a") - F.avg("col.b")).alias("difference"))


def rendered(df: DataFrame, keep: list[str], rate: int, kind: str, mono: str = "mono", azimuth: str = "azimuth") -> DataFrame:
    """df's keep columns with left and right: mono panned (`amplitude`) or placed at the ears (`binaural`)."""
    place = dsp.pan if kind == "amplitude" else lambda x, a: dsp.binaural(x, rate, a)

    def work(x: list, a: float) -> dict:
        left, right = place(np.asarray(x, float), a)
        return {"left": left, "right": right}

    return per_row(df, [mono, azimuth], keep, work, "left array<double>, right array<double>")


def processed(df: DataFrame, keep: list[str], rate: int, processing: str = "processing") -> DataFrame:
    """df's keep columns with left and right after the chain of each row."""

    def work(a: list, b: list, steps: list) -> dict:
        left, right = dsp.process(np.asarray(a, float), np.asarray(b, float), rate, [(s["kind"], dict(s["params"])) for s in steps or ()])
        return {"left": left, "right": right}

    return per_row(df, ["left", "right", processing], keep, work, "left array<double>, right array<double>")


def sources(df: DataFrame, keep: list[str], rate: int, most: int | None = None) -> DataFrame:
    """Azimuths and energy shares of the sources of a mix, strongest first."""

    def work(a: list, b: list) -> dict:
        found = dsp.mixture(np.asarray(a, float), np.asarray(b, float), rate, most=most)
        return {"azimuths": [x for x, _ in found], "shares": [s for _, s in found]}

    return per_row(df, ["left", "right"], keep, work, "azimuths array<double>, shares array<double>")


def pitches(df: DataFrame, keep: list[str], rate: int, low: float, high: float, mono: str = "mono") -> DataFrame:
    """Median f0 of voiced frames and their share."""

    def work(x: list) -> dict:
        try:
            f0, voiced = dsp.pitch_track(np.asarray(x, float), rate, low, high)
        except dsp.Unusable:
            return {}
        return {"f0_hz": float(np.median(f0[voiced])) if voiced.any() else None, "voiced_share": float(voiced.mean())}

    return per_row(df, [mono], keep, work, "f0_hz double, voiced_share double")


def tones(df: DataFrame, keep: list[str], rate: int, seconds: float, f: str = "f") -> DataFrame:
    """df's keep columns with a harmonic tone of each row's frequency."""
    return per_row(df, [f], keep, lambda x: {"mono": dsp.tone(x, rate, seconds)}, "mono array<double>")


#: Groups of more rows than this are fitted from their moments, smaller ones from their rows, which one task holds.
GROUP_ROWS = 4096
#: Weights of large groups that are broadcast at most.
BROADCAST_GROUPS = 10_000


def _vectors(column: pa.Array) -> np.ndarray:
    """Rows of one leading 1 and the features."""
    x = np.array(column.to_pylist(), float).reshape(len(column), -1)
    return np.column_stack([np.ones(len(x)), x])


def _moments(rows: DataFrame, by: str) -> DataFrame:
    """(by, pos, total): sums of products of 1, features and target, a row for each entry of the matrix. A task adds up its own rows first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            z = np.column_stack([_vectors(batch.column("x")), batch.column("y").to_numpy(zero_copy_only=False)])
            groups, at = np.unique(batch.column(by).to_numpy(zero_copy_only=False), return_inverse=True)
            sums = [(z[at == k].T @ z[at == k]).ravel() for k in range(len(groups))]
            yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array([x.tolist() for x in sums], pa.list_(pa.float64()))], names=[by, "s"])

    parts = rows.select(by, "x", "y").mapInArrow(add, f"{by} long, s array<double>")
    return parts.select(by, F.posexplode("s").alias("pos", "v")).groupBy(by, "pos").agg(F.sum("v").alias("total"))


def leave_one_group_out(df: DataFrame, key: str, features: str, target: str, group: str, ridge: float) -> DataFrame:
    """(key, g, y, predicted): ridge regression of each group on all others, the intercept not penalised.

    The moments of all rows are one matrix of (features + 2) squared numbers, the only thing that reaches the driver, and its inverse is
    broadcast. Leaving a group out takes its rows' products off that matrix, and the errors of its rows then follow from those of the
    model of all rows: (1 - X inv(A) X') e = y - X b. A group's rows meet in one task up to GROUP_ROWS of them; a larger group's own
    moments give its weights, in the task that holds these, and its rows stay where they are.
    """
    plain = df.select(F.col(key).alias("key"), F.col(features).cast("array<double>").alias("x"), F.col(target).cast("double").alias("y"), F.col(group).cast("long").alias("g"))
    total = {r["pos"]: r["total"] for r in _moments(plain.withColumn("all", F.lit(0).cast("long")), "all").collect()}
    wide = int(np.sqrt(len(total)))
    m = np.array([total[i] for i in range(wide * wide)]).reshape(wide, wide)
    penalty = ridge * np.diag([0.0] + [1.0] * max(wide - 2, 0))
    held = df.sparkSession.sparkContext.broadcast((m, penalty, np.linalg.inv(m[:-1, :-1] + penalty)) if wide else None)
    sizes = plain.groupBy("g").agg(F.count("*").alias("n"))
    large = sizes.filter(F.col("n") > GROUP_ROWS).select("g")
    own = plain.join(sizes.filter(F.col("n") <= GROUP_ROWS).select("g"), "g").groupBy("g").agg(F.collect_list(F.struct("key", "x", "y")).alias("rows"))

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, penalty, inverse = held.value
        for batch in batches:
            for g, rows in zip(batch.column("g").to_pylist(), batch.column("rows"), strict=True):
                flat = rows.values
                x, y = _vectors(flat.field("x")), flat.field("y").to_numpy(zero_copy_only=False)
                if len(x) < x.shape[1]:
                    error = np.linalg.solve(np.eye(len(x)) - x @ inverse @ x.T, y - x @ (inverse @ m[:-1, -1]))
                    guess = y - error
                else:
                    guess = x @ np.linalg.solve(m[:-1, :-1] + penalty - x.T @ x, m[:-1, -1] - x.T @ y)
                yield pa.RecordBatch.from_arrays([flat.field("key").cast(pa.int64()), pa.array([g] * len(x), pa.int64()), pa.array(y), pa.array(guess)], names=["key", "g", "y", "predicted"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, penalty, _ = held.value
        for batch in batches:
            found = []
            for s in batch.column("s").to_pylist():
                rest = m - np.array(s).reshape(m.shape)
                found.append(np.linalg.solve(rest[:-1, :-1] + penalty, rest[:-1, -1]).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("g"), pa.array(found, pa.list_(pa.float64()))], names=["g", "w"])

    moments = _moments(plain.join(large, "g"), "g").groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "total"))), lambda e: e["total"]).alias("s"))
    weights = moments.mapInArrow(fit, "g long, w array<double>")
    if large.count() <= BROADCAST_GROUPS:
        weights = F.broadcast(weights)
    dot = F.aggregate(F.zip_with("x", F.slice("w", 2, F.size("x")), lambda a, b: a * b), F.element_at("w", 1), lambda s, v: s + v)
    guessed = plain.join(weights, "g").select("key", "g", "y", dot.alias("predicted"))
    return own.mapInArrow(small, "key long, g long, y double, predicted double").unionByName(guessed)


def fit_quality(predicted: DataFrame) -> DataFrame:
    """Mean absolute error, R2 and the share within 5, of leave_one_group_out()."""
    error = F.col("predicted") - F.col("y")
    return predicted.agg(F.avg(F.abs(error)).alias("mae"), (1 - F.sum(error * error) / (F.var_pop("y") * F.count("*"))).alias("r2"), F.avg((F.abs(error) <= 5).cast("double")).alias("within_5"))


def _processor(kind: str, rate: int):
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("struct<left: array<double>, right: array<double>>")
    def step(left: pd.Series, right: pd.Series, params: pd.Series) -> pd.DataFrame:
        done = [dsp.process(np.asarray(a, float), np.asarray(b, float), rate, [(kind, dict(p))]) for a, b, p in zip(left, right, params)]
        return pd.DataFrame({"left": [a for a, _ in done], "right": [b for _, b in done]})

    return step


def register(spark, rate: int = 48_000) -> None:
    """Make the kernels callable from SQL: cue_measure(left, right) gives a struct, pitch_frames is a table function, and each kind of
    processing is a function cue_<kind>(left, right, params map)."""
    from pyspark.sql.functions import pandas_udf, udtf

    @pandas_udf("struct<ild_db: double, itd_us: double, coherence: double, azimuth_deg: double>")
    def cue_measure(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        rows = [dsp.measure(np.array(a, float), np.array(b, float), rate) for a, b in zip(left, right)]
        return pd.DataFrame({"ild_db": [r["ild_db"] for r in rows], "itd_us": [r["itd_us"] for r in rows], "coherence": [r["coherence"] for r in rows], "azimuth_deg": [r["estimated_azimuth_deg"] for r in rows]}, dtype=float)

    @udtf(returnType="t: double, f0: double, voiced: boolean")
    class PitchFrames:
        def eval(self, mono: list, low: float, high: float):
            f0, voiced = dsp.pitch_track(np.array(mono, float), rate, low, high)
            for i, (f, v) in enumerate(zip(f0.tolist(), voiced.tolist())):
                yield i * dsp.HOP_S, f, v

    for kind in dsp.KINDS:
        spark.udf.register(f"cue_{kind}", _processor(kind, rate))
    spark.udf.register("cue_measure", cue_measure)
    spark.udtf.register("pitch_frames", PitchFrames)
