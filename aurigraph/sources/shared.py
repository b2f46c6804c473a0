"""Files that the driver and all executors reach: a folder for what queries write, and stores by URI for Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, in local mode, below a temporary one; elsewhere an error."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="aurigraph-")
        context.setCheckpointDir(named)
    return f"{named.rstrip('/')}/aurigraph/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: its lineage ends there, and lost executors cost nothing of it."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), os.path.abspath(path)) if "://" not in path else fs.FileSystem.from_uri(path)


def files(path: str) -> list[fs.FileInfo]:
    """The files below path by name, without those whose name or folder starts with _ or a dot; none if there is no such folder."""
    where, root = store(path)
    found = where.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)) if where.get_file_info(root).type != fs.FileType.File else [where.get_file_info(root)]
    visible = lambda f: not any(p.startswith(("_", ".")) for p in f.path[len(root) :].split("/"))
    return sorted((f for f in found if f.type == fs.FileType.File and visible(f)), key=lambda f: f.path)
