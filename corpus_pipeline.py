"""The corpus pipeline: documents go through these stages in order, each stored as a table for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from aurigraph.llm import decontaminate, mixing, neardup, quality, sharding
from aurigraph.llm.common import discard, stored, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within the quantiles of trusted text of their language; null and empty texts go.

    A language without a trusted text keeps all that has a character. Repeated rows are judged alike; an empty table stays empty.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that share 0.8 of their five-word shingles stays: the first row of its smallest doc_id.

    Repeated rows of that id are one document. Rows without an id name no group and stay where no other row of the group has one.
    Null and wordless texts are one group. Candidates come from the deletion-variant signatures of SimHash fingerprints, as in op1, and, as
    fingerprints of such texts differ in about ten of 64 bits, from MinHash bands as well; every link is an exact similarity of the texts.
    """
    return neardup.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of test items; those that are mostly such passages go. Null texts stay as they are."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; null sources are one source, and one without words gives nothing."""
    return mixing.mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its place there."""
    return sharding.digest(sharding.shard(docs))


STAGES = [
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("decontamination", benchmark_decontamination),
    ("mixing", source_mixing),
    ("sharding", sharded),
]

#: Models and signatures are no SQL; tests hold near-dedup against all pairs of texts, the other stages against their operators, and those
#: against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        made = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(docs)  # the stage before, once this one is written
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
