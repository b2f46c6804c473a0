"""Labels, answers and annotations as JSON lines and text: readers that take every shape in use, and writers in a fixed order."""

from __future__ import annotations

import json
import math
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import committed

#: Lines of a packed file of training examples at most.
EXAMPLES = 100_000
EVIDENCE = ("ild_db", "high_frequency_ild_db", "ild_flatness_db", "itd_us", "itd_peak_strength", "coherence", "estimated_azimuth_deg", "estimated_regime", "active_bins", "f0_hz", "binaural_azimuth_deg")
_TEXT = {"estimated_regime": "string", "active_bins": "int"}
_EVIDENCE = "struct<" + ", ".join(f"{c}: {_TEXT.get(c, 'double')}" for c in EVIDENCE) + ">"
_LABELS = f"item_id string, build_id string, answer_side string, answer_azimuth_deg double, question struct<answer_side: string, answer_azimuth_deg: double>, render struct<instrument: string, stem_id: string, piece_id: string>, measured_evidence {_EVIDENCE}"


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Private labels or published items: the answer stands at the top or in `question`. Missing pitch and angle are NaN."""
    raw = spark.read.schema(_LABELS).json(path)
    e = F.col("measured_evidence")
    for name in ("f0_hz", "binaural_azimuth_deg"):
        e = F.when(e.isNotNull(), e.withField(name, F.coalesce(e[name], F.lit(math.nan))))
    return raw.select("item_id", "build_id", F.coalesce("answer_side", "question.answer_side").alias("answer_side"), F.coalesce("answer_azimuth_deg", "question.answer_azimuth_deg").alias("azimuth"), F.col("render.instrument").alias("instrument"), F.col("render.stem_id").alias("stem"), F.col("render.piece_id").alias("piece"), e.alias("evidence"))


def answers(spark: SparkSession, path: str) -> DataFrame:
    """(item_id, answer): `answer`, or `transcript` where there is no such key; null is an error. The last line of an id counts: by
    the line's `attempt` if it has one, then by file, as their times and names go, and by place in the file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).filter("trim(value) <> ''")
    value = F.col("value")
    got = lines.select(F.get_json_object(value, "$.item_id").alias("item_id"), F.get_json_object(value, "$.attempt").cast("long").alias("attempt"), "time", "file", "block", "n", F.get_json_object(value, "$.answer").alias("a"), F.get_json_object(value, "$.transcript").alias("t"), F.array_contains(F.json_object_keys(value), "answer").alias("own"))
    text = F.coalesce(F.when(F.col("own"), F.col("a")).otherwise(F.col("t")), F.raise_error(F.lit("an answer is null")))
    order = F.struct(F.coalesce("attempt", F.lit(-1)).alias("attempt"), "time", "file", "block", "n")
    return got.withColumn("answer", text).groupBy("item_id").agg(F.max_by("answer", order).alias("answer"))


_SOURCES = "struct<source_azimuths_deg: array<double>, source_energy_fractions: array<double>, active_bins: int>"


def mixture_labels(spark: SparkSession, path: str) -> DataFrame:
    """(item_id, azimuths, evidence) of mixtures: the azimuths stand at the top or in `question`."""
    raw = spark.read.schema(f"item_id string, answer_azimuths_deg array<double>, question struct<answer_azimuths_deg: array<double>>, measured_evidence {_SOURCES}").json(path)
    return raw.select("item_id", F.coalesce("answer_azimuths_deg", "question.answer_azimuths_deg").alias("azimuths"), F.col("measured_evidence").alias("evidence"))


def report(spark: SparkSession, path: str) -> DataFrame:
    """A report or survey that is one JSON object over many lines."""
    return spark.read.option("multiLine", "true").json(path)


def annotation_paths(path: Column) -> Column:
    """Where the pitch annotation of an audio file may be, likelier first."""
    folder, name = F.regexp_extract(path, r"^(.*/)?[^/]*$", 1), F.regexp_extract(path, r"([^/]*)$", 1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.array(F.concat(folder, F.lit("F0s_"), stem, F.lit(".txt")), F.concat(folder, F.regexp_replace(stem, "AuSep_", "F0s_"), F.lit(".txt")))


def with_annotation(audio: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """audio with `annotation`: the first of its annotation_paths() that is among files (path), or null."""
    asked = audio.select(path, F.posexplode(annotation_paths(F.col(path))).alias("k", "annotation"))
    there = asked.join(files.select(F.col("path").alias("annotation")).distinct(), "annotation", "left_semi")
    return audio.join(there.groupBy(path).agg(F.min_by("annotation", "k").alias("annotation")), path, "left")


def build_id(spark: SparkSession, path: str) -> str | None:
    """Of the first line that is not blank."""
    first = spark.read.text(path).filter("trim(value) <> ''").select(F.from_json("value", "build_id string")["build_id"].alias("b")).first()
    return first["b"] if first else None


def check_build_ids(ours: str | None, theirs: str | None) -> None:
    """Different builds are an error; an unknown one is not."""
    if ours is not None and theirs is not None and ours != theirs:
        raise ValueError(f"labels are of build {ours}, answers of build {theirs}")


#: What a build configuration has where it says nothing.
DEFAULTS = {"rendering": "amplitude", "processing_recipes": [], "retry_quiet_excerpts": False, "max_excerpt_retries": 1, "maximum_peak": 0.99, "minimum_rms_db": -45.0, "azimuth_tolerance_degrees": 5.0}
_NUMBERS = {"seed": int, "sample_rate": int, "max_excerpt_retries": int, "clip_duration_seconds": float, "azimuth_tolerance_degrees": float, "maximum_peak": float, "minimum_rms_db": float}


def config(path: str) -> dict:
    """A build configuration with its defaults; numbers are brought to their types, and folders are relative to the file's own."""
    here = Path(path).resolve().parent
    read = DEFAULTS | json.loads(Path(path).read_text())
    for key, kind in _NUMBERS.items():
        if key in read:
            read[key] = kind(read[key])
    for key in ("source_root", "output_root"):
        if key in read:
            read[key] = str((here / read[key]).resolve())
    if "angles_degrees" in read:
        read["angles_degrees"] = [float(a) for a in read["angles_degrees"]]
    return read


def fingerprint(read: dict) -> str:
    """12 hex digits of what a build depends on, as canonical JSON."""
    import hashlib

    names = ("benchmark_name", "version", "seed", "sample_rate", "clip_duration_seconds", "angles_degrees", "azimuth_tolerance_degrees", "rendering", "processing_recipes")
    payload = json.dumps({n: read[n] for n in names if n in read}, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(payload.encode()).hexdigest()[:12]


def f0_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(t, f0) of tab-separated lines; 0 is unvoiced."""
    return spark.read.schema("t double, f0 double").option("sep", "\t").csv(path)


def write_f0_annotations(df: DataFrame, path: str) -> None:
    df.orderBy("t").select(F.format_string("%.3f\t%.3f", "t", "f0").alias("value")).write.text(path)


def write_jsonl(df: DataFrame, path: str, *order: str) -> None:
    """JSON lines with sorted keys; files follow the order of the given columns."""
    rows = df.select(*sorted(df.columns))
    (rows.orderBy(*order) if order else rows).write.json(path, ignoreNullFields=False)


def write_splits(df: DataFrame, path: str) -> None:
    """Rows by split, each in a folder of its own."""
    df.write.partitionBy("split").json(path)


def write_split_ids(df: DataFrame, path: str, key: str) -> None:
    """The keys of each split, one a line and sorted, in a folder for the split."""
    df.select("split", F.col(key).cast("string").alias("value")).repartition("split").sortWithinPartitions("split", "value").write.partitionBy("split").text(path)


def benchmark_lines(items: DataFrame, rejected: DataFrame, public: list[str], private: list[str], key: str = "item_id") -> DataFrame:
    """(output, line, key): every line of the five files of a benchmark, from one reading of the items."""
    whole = committed.as_json(*items.columns)
    to = lambda output, line: F.struct(F.lit(output).alias("output"), line.alias("line"))
    split = F.col("split")
    outputs = F.when(split.isin("train", "dev"), F.array(F.struct(split.alias("output"), whole.alias("line")))).when(split == "test", F.array(to("test_public", committed.as_json(*public)), to("test_private_labels", committed.as_json(*private))))
    lines = items.select(F.col(key).cast("string").alias("key"), F.inline(outputs)).select("output", "line", "key")
    return lines.unionByName(rejected.select(F.lit("rejected_items").alias("output"), committed.as_json(*rejected.columns).alias("line"), F.lit(None).cast("string").alias("key")))


def write_benchmark(items: DataFrame, rejected: DataFrame, path: str, public: list[str], private: list[str], key: str = "item_id", job: str = "build") -> None:
    """The five files of a benchmark, each a folder of JSON lines in order of the key: train and dev whole, what of the test items may be
    published, their private labels, and what was rejected. All commit at once under the job's name, and a second run of that job adds
    nothing. Items are read once for the lines, and once by key alone for the bounds of the order."""
    lines = benchmark_lines(items, rejected, public, private, key)
    committed.write(lines.repartitionByRange("key", "output").sortWithinPartitions("key"), path, job)


def write_json(df: DataFrame, path: str) -> None:
    """One row as one JSON object on one line, keys sorted, nulls kept: a summary."""
    df.select(*sorted(df.columns)).coalesce(1).write.json(path, ignoreNullFields=False)


def write_reports(reports: DataFrame, labels: str, items: int, path: str) -> None:
    """The reports of several conditions in one object: {labels, items, reports}. A row a condition."""
    rows = reports.agg(F.collect_list(F.struct(*reports.columns)).alias("reports"))  # a few conditions
    rows.select(F.lit(labels).alias("labels"), F.lit(items).alias("items"), "reports").coalesce(1).write.json(path, ignoreNullFields=False)


def write_examples(examples: DataFrame, path: str, packed: bool = False) -> None:
    """Training examples as JSON lines, keys in a fixed order. Packed files take a fraction of the space, as prompts repeat each other; as
    one is read by one task, none has more than EXAMPLES lines."""
    writer = examples.select("item_id", "audio_path", "prompt", "target", "condition").write
    if packed:
        writer.option("maxRecordsPerFile", EXAMPLES).json(path, compression="gzip")
    else:
        writer.json(path)


def write_surveys(surveys: DataFrame, path: str) -> None:
    """Surveys (track, survey as JSON text), one a line."""
    surveys.select(F.col("survey").alias("value")).write.text(path)


def write_embeddings(df: DataFrame, path: str) -> None:
    """A cache of embeddings with their targets and groups."""
    df.write.mode("overwrite").parquet(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_answers(df: DataFrame, path: str) -> None:
    df.select(*sorted(df.columns)).write.mode("append").json(path)
