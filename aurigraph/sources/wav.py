"""WAV files: scans of their headers, decoded excerpts, and bytes of a signal. Standard-library decoding, a file at a time."""

from __future__ import annotations

import io
import uuid
import wave
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dsp
from .shared import store

SUFFIXES = ("wav", "flac", "mp3", "ogg", "m4a", "aiff", "aif")


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(path, length): audio files below root by suffix. Only WAV can be decoded here."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", "length").filter(F.lower("path").rlike(r"\.(" + "|".join(SUFFIXES) + ")$"))


def stems(spark: SparkSession, root: str, pattern: str = "AuSep_*.wav") -> DataFrame:
    """(path, stem, rate, channels, frames, sha256) of the files of a dataset; headers are read by the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    hashed = files.select("path", "content", F.sha2("content", 256).alias("sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for content in batch.column("content").to_pylist():
                with wave.open(io.BytesIO(content)) as w:
                    found.append((w.getframerate(), w.getnchannels(), w.getnframes()))
            columns = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("sha256"), *columns], names=["path", "sha256", "rate", "channels", "frames"])

    found = hashed.mapInArrow(run, "path string, sha256 string, rate int, channels int, frames long").withColumn("stem", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1))
    return found.withColumn("channels", F.when(F.col("channels") != 1, F.raise_error(F.concat("path", F.lit(" is not mono"))).cast("int")).otherwise(F.col("channels")))


def inventory(spark: SparkSession, root: str, pattern: str = "AuSep_*.wav") -> DataFrame:
    """stems() in order of their paths; an error if there are none."""
    found = stems(spark, root, pattern).orderBy("path")
    if found.isEmpty():
        raise FileNotFoundError(f"no file below {root} is like {pattern}")
    return found


def decode(content: bytes) -> tuple[np.ndarray, int]:
    """(samples x channels in -1..1, rate) of 8, 16, 24 or 32 bit PCM."""
    with wave.open(io.BytesIO(content)) as w:
        width, channels, rate, raw = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
    return pcm(raw, width).reshape(-1, channels), rate


def pcm(raw: bytes, width: int) -> np.ndarray:
    """Samples in -1..1 of PCM of so many bytes a sample."""
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]) / float(1 << (8 * width - 1))
    return x


def encode(channels: list[np.ndarray], rate: int, bits: int = 16) -> bytes:
    """PCM of 16 or 24 bits; samples beyond -1..1 are clipped."""
    scale = (1 << (bits - 1)) - 1
    x = np.rint(np.clip(np.column_stack(channels), -1, 1) * scale).astype("<i4")
    raw = x.astype("<i2").tobytes() if bits == 16 else x.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(len(channels))
        w.setsampwidth(bits // 8)
        w.setframerate(rate)
        w.writeframes(raw)
    return out.getvalue()


def read_at(file: BinaryIO, start_s: float, duration_s: float, rate: int) -> np.ndarray:
    """An excerpt of an open file, mixed down, resampled and padded to its exact length; only its header and frames are read."""
    with wave.open(file) as w:
        own, width, channels = w.getframerate(), w.getsampwidth(), w.getnchannels()
        w.setpos(min(round(start_s * own), w.getnframes()))
        raw = w.readframes(round(duration_s * own))
    n = round(duration_s * rate)
    part = dsp.resample(pcm(raw, width).reshape(-1, channels).mean(1), own, rate)[:n]
    return np.concatenate([part, np.zeros(n - len(part))])


def excerpts(spark: SparkSession, plans: DataFrame, root: str, rate: int, keep: list[str], pattern: str = "*.wav") -> DataFrame:
    """keep columns of plans (stem, start_s, duration_s, ...) with mono, each plan's own excerpt of its stem's file; a stem without a
    file is an error. Plans meet the paths of files, never their contents; a task opens the file of a plan and reads the plan's frames."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("stem"), F.col("path").alias("file"))
    met = plans.join(files, "stem", "left").withColumn("file", F.coalesce("file", F.raise_error(F.concat(F.lit("no file of stem "), F.col("stem"))).cast("string")))
    kept = plans.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path, start, duration in zip(*(batch.column(x).to_pylist() for x in ("file", "start_s", "duration_s")), strict=True):
                where, name = store(path)
                with where.open_input_file(name) as f:
                    found.append(read_at(f, start, duration, rate))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(found, pa.list_(pa.float64()))], names=[*keep, "mono"])

    return met.select(*dict.fromkeys([*keep, "file", "start_s", "duration_s"])).mapInArrow(run, ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept] + ["mono array<double>"]))


def stereo(spark: SparkSession, root: str, rate: int = 48_000, pattern: str = "*.wav") -> DataFrame:
    """(path, left, right) of stereo files at one rate; another number of channels is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides: list[list[np.ndarray]] = [[], []]
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                x, own = decode(content)
                if x.shape[1] != 2:
                    raise ValueError(f"{path} has {x.shape[1]} channels, not two")
                for side, column in zip(sides, x.T):
                    side.append(dsp.resample(column, own, rate))
            yield pa.RecordBatch.from_arrays([batch.column("path"), *(pa.array(s, pa.list_(pa.float64())) for s in sides)], names=["path", "left", "right"])

    return files.mapInArrow(run, "path string, left array<double>, right array<double>")


def as_wav(df: DataFrame, keep: list[str], rate: int, bits: int = 16) -> DataFrame:
    """df's keep columns with `wav`, the bytes of (left, right)."""
    kept = df.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [encode([np.array(a), np.array(b)], rate, bits) for a, b in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(blobs, pa.binary())], names=[*keep, "wav"])

    return df.select(*keep, "left", "right").mapInArrow(run, ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept] + ["wav binary"]))


def write_files(df: DataFrame, folder: str, name: str = "name", content: str = "wav") -> int:
    """Each row's bytes as a file of its name below folder; returns how many. A file appears under its name when it is whole, and a task
    that runs again writes the same file again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = store(folder)
        where.create_dir(root)
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                draft = f"{root}/.{uuid.uuid4().hex}"
                with where.open_output_stream(draft) as f:
                    f.write(data)
                where.move(draft, f"{root}/{file}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return df.select(name, content).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def from_wav(df: DataFrame, keep: list[str]) -> DataFrame:
    """df's keep columns with left and right of `wav`, its bytes; mono gives two equal channels."""
    kept = df.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [decode(content)[0] for content in batch.column("wav").to_pylist()]
            left, right = ([x[:, 0] for x in found], [x[:, -1] for x in found])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(left, pa.list_(pa.float64())), pa.array(right, pa.list_(pa.float64()))], names=[*keep, "left", "right"])

    return df.select(*keep, "wav").mapInArrow(run, ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept] + ["left array<double>", "right array<double>"]))
