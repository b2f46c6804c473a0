"""A sink for several outputs at once that commits as a whole, and the source that reads what was committed.

Tasks write part files into a staging folder and return what they wrote; the commit moves them to their outputs and publishes one
manifest, a new version, that names all files that count. What no manifest names does not exist for the reader: files of killed tasks,
of attempts that lost, of jobs that failed. A job has a name, its files are named after it, and a job that was committed is never
committed again: running it once more changes nothing, nor does a job without a line. A writer that must have seen all that was there before names the version it
has read; if another was published since, it fails and leaves nothing.

Rows are (output, line), in any number of outputs; within a part file lines keep their order, and part files are numbered by partition.
An output is a folder of plain files, "" the folder itself, so any reader of lines can read it as well.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from .shared import store

FORMAT = "committed_lines"
SCHEMA = "output string, line string"
MANIFESTS, STAGING = "_manifests", "_staging"


class Conflict(RuntimeError):
    """Another writer has published a version in between."""


def manifest(path: str) -> dict:
    """The latest manifest: version, jobs and files; version 0 where nothing was committed."""
    where, root = store(path)
    found = where.get_file_info(fs.FileSelector(f"{root}/{MANIFESTS}", allow_not_found=True))
    last = max((f.path for f in found if f.path.endswith(".json")), default=None)
    if last is None:
        return {"version": 0, "jobs": [], "files": []}
    with where.open_input_stream(last) as f:
        return json.loads(f.read())


def _publish(where: fs.FileSystem, root: str, state: dict) -> bool:
    """Write a manifest unless there is one of its version. Atomic on local disks; elsewhere as far as the store's move is."""
    folder = f"{root}/{MANIFESTS}"
    where.create_dir(folder)
    name, draft = f"{folder}/{state['version']:012d}.json", f"{folder}/.{uuid.uuid4().hex}"
    with where.open_output_stream(draft) as f:
        f.write(json.dumps(state, sort_keys=True).encode())
    try:
        if isinstance(where, fs.LocalFileSystem):
            os.link(draft, name)
        elif where.get_file_info(name).type != fs.FileType.NotFound:
            return False
        else:
            where.move(draft, name)
    except FileExistsError:
        return False
    finally:
        if where.get_file_info(draft).type != fs.FileType.NotFound:
            where.delete_file(draft)
    return True


@dataclass
class Parts(WriterCommitMessage):
    """What a task wrote: (output, staged name, place among parts, rows, sha256)."""

    parts: list[tuple[str, str, str, int, str]] = field(default_factory=list)


class LinesWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.job, self.overwrite = options["path"], options["job"], overwrite
        self.expect = int(options["expect"]) if "expect" in options else None
        self.run = uuid.uuid4().hex
        if "/" in self.job or not self.job or self.job.startswith(("_", ".")):
            raise ValueError("a job's name is a file name")

    def _staging(self, root: str) -> str:
        return f"{root}/{STAGING}/{self.job}-{self.run}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Parts:
        where, root = store(self.path)
        context = TaskContext.get()
        number = context.partitionId() if context else 0
        where.create_dir(self._staging(root))
        opened: dict[str, list] = {}
        try:
            for batch in iterator:
                for output, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if output not in opened:
                        if "/" in output or output.startswith(("_", ".")):
                            raise ValueError(f"{output!r} is no name of an output")
                        staged = uuid.uuid4().hex
                        opened[output] = [where.open_output_stream(f"{self._staging(root)}/{staged}"), staged, 0, hashlib.sha256()]
                    if "\n" in line:
                        raise ValueError("a line holds a line break")
                    data = line.encode() + b"\n"
                    slot = opened[output]
                    slot[0].write(data)
                    slot[2] += 1
                    slot[3].update(data)
        finally:
            for stream, *_ in opened.values():
                stream.close()
        return Parts([(output, staged, f"{number:06d}", rows, sha.hexdigest()) for output, (_, staged, rows, sha) in sorted(opened.items())])

    def commit(self, messages: list) -> None:
        where, root = store(self.path)
        parts = [p for m in messages if m is not None for p in m.parts]
        state = manifest(self.path)
        try:
            if self.job in state["jobs"] or not parts and not self.overwrite:
                return
            if self.expect is not None and self.expect != state["version"]:
                raise Conflict(f"version {state['version']} was published after {self.expect}")
            made = []
            for output, staged, number, rows, sha in parts:
                where.create_dir(f"{root}/{output}")
                name = f"{output}/part-{number}-{self.job}.jsonl".lstrip("/")
                where.move(f"{self._staging(root)}/{staged}", f"{root}/{name}")
                made.append({"output": output, "file": name, "rows": rows, "sha256": sha})
            while True:
                kept, jobs = ([], []) if self.overwrite else (state["files"], state["jobs"])
                if _publish(where, root, {"version": state["version"] + 1, "jobs": [*jobs, self.job], "files": [*kept, *made]}):
                    break
                state = manifest(self.path)
                if self.job in state["jobs"]:
                    return
                if self.expect is not None:
                    for f in made:
                        where.delete_file(f"{root}/{f['file']}")
                    raise Conflict(f"version {state['version']} was published after {self.expect}")
            self._sweep(where, root, state["files"] if self.overwrite else [], {f["file"] for f in made})
        finally:
            self._drop(where, root)

    def _sweep(self, where: fs.FileSystem, root: str, replaced: list[dict], made: set[str]) -> None:
        """Delete files that an overwrite has replaced, and those that an earlier run of this job moved but never published."""
        for f in replaced:
            if f["file"] not in made and where.get_file_info(f"{root}/{f['file']}").type == fs.FileType.File:
                where.delete_file(f"{root}/{f['file']}")
        for f in where.get_file_info(fs.FileSelector(root, recursive=True)):
            name = f.path[len(root) + 1 :]
            if f.type == fs.FileType.File and re.fullmatch(rf"part-\d+-{re.escape(self.job)}\.jsonl", f.base_name) and not name.startswith("_") and name not in made:
                where.delete_file(f.path)

    def _drop(self, where: fs.FileSystem, root: str) -> None:
        if where.get_file_info(self._staging(root)).type == fs.FileType.Directory:
            where.delete_dir(self._staging(root))

    def abort(self, messages: list) -> None:
        self._drop(*store(self.path))


@dataclass
class File(InputPartition):
    output: str
    file: str
    rows: int


class LinesReader(DataSourceReader):
    """Partitions are committed files; equality filters on output leave the others unopened."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.version = int(options["version"]) if "version" in options else None
        self.only: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("output",):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = named if self.only is None else self.only & named
            else:
                yield f

    def partitions(self) -> list[File]:
        if self.version is None:
            state = manifest(self.path)
        else:
            where, root = store(self.path)
            with where.open_input_stream(f"{root}/{MANIFESTS}/{self.version:012d}.json") as f:
                state = json.loads(f.read())
        return [File(f["output"], f["file"], f["rows"]) for f in state["files"] if self.only is None or f["output"] in self.only]

    def read(self, partition: File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing is committed
            return
        where, root = store(self.path)
        with where.open_input_stream(f"{root}/{partition.file}") as f:
            rest = b""
            while data := f.read(1 << 22):
                *lines, rest = (rest + data).split(b"\n")
                if lines:
                    yield pa.RecordBatch.from_arrays([pa.array([partition.output] * len(lines)), pa.array([x.decode() for x in lines], pa.string())], names=["output", "line"])


class CommittedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LinesReader:
        return LinesReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> LinesWriter:
        return LinesWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CommittedLines)


def write(lines: DataFrame, path: str, job: str, expect: int | None = None, overwrite: bool = False) -> None:
    """Commit (output, line) rows as one version; expect: the version that must still be the latest."""
    register(lines.sparkSession)
    writer = lines.select(F.col("output").cast("string").alias("output"), F.col("line").cast("string").alias("line")).write.format(FORMAT).option("path", path).option("job", job)
    if expect is not None:
        writer = writer.option("expect", str(expect))
    writer.mode("overwrite" if overwrite else "append").save()


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(output, line) of the latest version, or of an earlier one whose files no overwrite has replaced."""
    register(spark)
    reader = spark.read.format(FORMAT).option("path", path)
    return (reader if version is None else reader.option("version", str(version))).load()


def as_json(*columns: str) -> F.Column:
    """A row's columns as a JSON object, keys sorted, nulls kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
