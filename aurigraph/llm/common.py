"""Helpers that the corpus operators share: shared-folder tables, text to bytes, Arrow plumbing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Of the groups that one key joins, those with more than this part of all rows go by broadcast: there can't be more than HOT of them.
HOT = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which every executor sees. Where it is unset, a new one in local mode, where
    driver and executors are one machine; elsewhere an error, as files on one machine's disk would be lost to the others."""
    small_batches(spark)
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="aurigraph-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/aurigraph/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.__dict__["_stored_at"] = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete what stored() wrote, once everything that reads it is written itself."""
    for t in tables:
        if path := t.__dict__.pop("_stored_at", None):
            where = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, a write, a checkpoint or a collect deletes the shuffle files that it made as soon as it has ended, instead of whenever the
    driver's garbage is next collected. For steps that store what they make: a frame that is run once more makes its shuffles anew.

    Not for steps in which a query may end while one of its stages still runs, as Spark lets it where the other side of a join turns out
    empty: that stage's next task finds its shuffle gone, which stops the Spark context. Those call garbage_collected() between steps."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def garbage_collected(spark: SparkSession) -> None:
    """Let the driver find the shuffles that no frame or running stage needs any more, so that Spark deletes their files."""
    spark._jvm.System.gc()


def fresh(df: DataFrame, name: str) -> str:
    """name, or with underscores after it, such that df has no column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def meet(rows: DataFrame, groups: DataFrame, key: str, count: str, total: int, how: str = "inner", hint: str | None = None) -> DataFrame:
    """rows joined with groups, one row for each key, of which `count` says how many of the `total` rows have it. The few that
    are a hot key go by broadcast, whose size is bounded (fewer than HOT rows), the others by a shuffle join, or by the join that hint names."""
    hot = F.col(count) > F.lit(total / HOT)
    few, rest = groups.filter(hot), groups.filter(~hot)
    others = rows.join(F.broadcast(few.select(key)), key, "left_anti")
    return rows.join(F.broadcast(few), key).unionByName(others.join(rest.hint(hint) if hint else rest, key, how))


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder; for the small tables of iterations."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def small_batches(spark: SparkSession) -> None:
    """Let Spark hand rows to Python in batches of a few MB instead of 10,000 rows, which may be gigabytes of long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def by_batch(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, most_bytes: int = 8 << 20) -> DataFrame:
    """mapInArrow of a function of one batch; batches are small, so a worker holds few texts at once."""

    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = rows_within(batch, most_bytes)
            for start in range(0, batch.num_rows, step):
                yield work(batch.slice(start, step))

    return df.mapInArrow(run, schema)


def rows_within(batch: pa.RecordBatch, most_bytes: int = 8 << 20) -> int:
    """How many rows of the batch make about most_bytes."""
    if batch.num_rows == 0:
        return 1
    return max(1, min(batch.num_rows, int(batch.num_rows * most_bytes / max(1, batch.nbytes))))


def utf8(column: pa.Array) -> list[bytes | None]:
    """Texts as UTF-8 bytes, without decoding them."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unit(*columns, seed: int) -> F.Column:
    """A number in [0, 1) that only depends on the columns and the seed."""
    return F.shiftrightunsigned(F.xxhash64(*columns, F.lit(seed)), 11).cast("double") * F.lit(2.0**-53)
