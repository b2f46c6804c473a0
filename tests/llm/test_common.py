from __future__ import annotations

import os
import time

import pytest
from aurigraph.llm import common
from pyspark.sql import functions as F


def test_stored_tables_can_be_discarded(spark):
    table = common.stored(spark.range(5), "test")
    path = table.__dict__["_stored_at"]
    assert table.count() == 5 and os.path.isdir(path)
    common.discard(table, table, spark.range(1))
    assert not os.path.exists(path)


def test_a_machine_local_folder_is_for_local_mode(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Conf(dict):
        def set(self, *_):
            pass

    class Session:
        sparkContext, conf = Context(), Conf()  # noqa: N815

    with pytest.raises(RuntimeError, match="share"):
        common.shared_dir(Session())


def test_shuffle_files_go_once_a_table_is_stored(spark):
    """Only what is stored within the block, and frames that are run again give the same rows."""
    made = spark._jsc.sc().env().blockManager().diskBlockManager()
    files = lambda: {f.name() for f in _each(made.getAllBlocks()) if f.isShuffle()}
    grouped = lambda: spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count()
    with common.shuffles_dropped(spark):
        before, frame = files(), grouped()
        kept = common.stored(frame, "test")
        pieces = common.cut(grouped())
        assert kept.count() == pieces.count() == 100
        until = time.time() + 20  # files go in the background
        while (left := files() - before) and time.time() < until:
            time.sleep(0.1)
        assert not left
        assert len(frame.collect()) == len(frame.collect()) == 100
    before = files()
    common.stored(grouped(), "test")
    assert files() - before


def _each(found):
    return [found.apply(i) for i in range(found.size())]


def test_fresh_names_and_hot_keys(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a")] * 30 + [(2, "b"), (3, "c"), (None, "d")], "k long, Row string")
    assert common.fresh(rows, "row") == "row_" and common.fresh(rows, "x") == "x"
    monkeypatch.setattr(common, "HOT", 3)
    groups = spark.createDataFrame([(1, 30), (2, 1), (4, 1)], "k long, n long")
    assert common.meet(rows, groups, "k", "n", 33).count() == 31
    assert common.meet(rows, groups, "k", "n", 33, "left").count() == 33
