from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word of a very long text " * 20_000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 69),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 69),
    (3, "", "en", "b", 0),
    (4, None, None, None, None),
    (5, LONG, "de", "a", len(LONG)),
    (6, "Ein kurzer Satz mit Straße und Übung", "de", "b", 36),
    (6, "Ein kurzer Satz mit Straße und Übung", "de", "b", 36),
    (7, "!!! ??? 123", "fr", "c", 11),
    (8, "the quick brown fox JUMPS over the lazy dog near the river bank today", "en", None, 69),
    (9, " \n\t ", None, "c", 4),
    (10, "emoji \U0001f600 and nul \x01 text", "en", "c", 24),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, other columns with clashing names."""
    frame = spark.createDataFrame(ROWS, SCHEMA)
    from pyspark.sql import functions as F

    return frame.withColumn("size", F.lit(1)).withColumn("fp", F.lit("x")).withColumn("row", F.lit("y")).withColumn("g", F.lit(2.5)).withColumn("key", F.lit("k")).withColumn("salt", F.lit("s")).withColumn("copies", F.lit("c"))


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def items(spark):
    return spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog near the river"), (2, "Straße und Übung"), (3, ""), (4, None), (None, "the lazy dog")], "item_id long, text string")
