"""Sources whose partitions are stretches of files: frames of WAV files, lines of text files. A task opens its file, seeks, and reads its
stretch and nothing else; filters on paths and places reach the plan of partitions, so what they leave out is not opened."""

from __future__ import annotations

import wave
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition, LessThan

from .shared import files, store
from .wav import pcm

#: Bytes of a stretch, unless an option says otherwise; what a partition of short ones may add up to, each counted with its opening.
STRETCH = 8 << 20
BUNDLE, OPENING = 32 << 20, 256 << 10


@dataclass
class Stretch:
    """A byte range of a file."""

    path: str
    first: int
    end: int


@dataclass
class Bundle(InputPartition):
    """Stretches that one task reads in turn."""

    stretches: list[Stretch]


class _Ranges(DataSourceReader):
    """Partitions by the listing alone: no file is opened to plan."""

    place = "offset"

    def __init__(self, options: dict):
        self.root, self.suffix = options["path"], options.get("suffix", "")
        self.stretch = int(options.get("stretch", STRETCH))
        self.paths: set[str] | None = None
        self.low, self.high = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("path",):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.paths = named if self.paths is None else self.paths & named
            else:
                if isinstance(f, GreaterThanOrEqual) and f.attribute == (self.place,):
                    self.low = max(self.low, f.value)
                if isinstance(f, LessThan) and f.attribute == (self.place,):
                    self.high = f.value if self.high is None else min(self.high, f.value)
                yield f  # stretches are coarser than places

    def stretches(self) -> list[Stretch]:
        found = [f for f in files(self.root) if f.path.endswith(self.suffix) and (self.paths is None or f.path in self.paths)]
        return [Stretch(f.path, at, min(at + self.stretch, f.size)) for f in found for at in range(0, f.size, self.stretch)]

    def partitions(self) -> list[Bundle]:
        made, weight = [], 0
        for s in self.stretches():
            cost = s.end - s.first + OPENING
            if not made or weight + cost > BUNDLE:
                made.append(Bundle([]))
                weight = 0
            made[-1].stretches.append(s)
            weight += cost
        return made

    def read(self, partition: Bundle | None) -> Iterator[pa.RecordBatch]:
        for s in partition.stretches if partition else ():  # no partition: no file
            yield from self.rows(s)


class FramesReader(_Ranges):
    """(path, start, rate, channels, samples): blocks of frames, start being the first frame, samples interleaved in -1..1."""

    place = "start"

    def rows(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        where, _ = store(self.root)
        with where.open_input_file(partition.path) as raw, wave.open(raw) as w:
            width = w.getsampwidth() * w.getnchannels()
            first, end = -(-partition.first // width), min(-(-partition.end // width), w.getnframes())  # the header's frames fill up the last stretch
            first, end = max(first, self.low), end if self.high is None else min(end, self.high)
            if first >= end:
                return
            w.setpos(first)
            x = pcm(w.readframes(end - first), w.getsampwidth())
            names = ["path", "start", "rate", "channels", "samples"]
            yield pa.RecordBatch.from_arrays([pa.array([partition.path]), pa.array([first], pa.int64()), pa.array([w.getframerate()], pa.int32()), pa.array([w.getnchannels()], pa.int32()), pa.array([x], pa.list_(pa.float64()))], names=names)


class LinesReader(_Ranges):
    """(path, offset, line): a line belongs to the stretch in which it begins; offset is its first byte."""

    def stretches(self) -> list[Stretch]:
        return [s for s in super().stretches() if s.end > self.low and (self.high is None or s.first < self.high)]

    def rows(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        where, _ = store(self.root)
        with where.open_input_file(partition.path) as f:
            at = max(partition.first - 1, 0)
            f.seek(at)
            data = f.read(partition.end - at)
            if partition.first and b"\n" not in data:  # the middle of a line
                return
            while data and not data.endswith(b"\n") and (more := f.read(1 << 16)):
                cut = more.find(b"\n")
                data += more if cut < 0 else more[: cut + 1]
                if cut >= 0:
                    break
        if partition.first:  # the line that the byte before belongs to is another stretch's
            skip = data.find(b"\n") + 1
            data, at = data[skip:], at + skip
        lines = data.split(b"\n")
        if not lines[-1]:
            lines.pop()
        sizes = np.array([len(x) + 1 for x in lines], np.int64)
        offsets = at + np.cumsum(sizes) - sizes
        kept = [i for i, o in enumerate(offsets) if o < partition.end]
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(kept)), pa.array(offsets[kept], pa.int64()), pa.array([lines[i].decode() for i in kept], pa.string())], names=["path", "offset", "line"])


class Frames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav_frames"

    def schema(self) -> str:
        return "path string, start long, rate int, channels int, samples array<double>"

    def reader(self, schema) -> FramesReader:
        return FramesReader(dict(self.options))


class Lines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "line_pages"

    def schema(self) -> str:
        return "path string, offset long, line string"

    def reader(self, schema) -> LinesReader:
        return LinesReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Frames, Lines):
        spark.dataSource.register(source)


def _load(spark: SparkSession, kind: str, path: str, stretch: int, suffix: str) -> DataFrame:
    register(spark)
    return spark.read.format(kind).option("path", path).option("stretch", str(stretch)).option("suffix", suffix).load()


def frames(spark: SparkSession, path: str, stretch: int = STRETCH, suffix: str = ".wav") -> DataFrame:
    """Frames of the WAV files below path, a row for each stretch of bytes that holds any."""
    return _load(spark, "wav_frames", path, stretch, suffix)


def lines(spark: SparkSession, path: str, stretch: int = STRETCH, suffix: str = "") -> DataFrame:
    """Lines of the text files below path. A line longer than a stretch is read by the task in whose stretch it begins."""
    return _load(spark, "line_pages", path, stretch, suffix)
