"""Records of any shape as VARIANT: one column that keeps the whole line, read by path, so an unknown field or version is not lost.

A line that is no JSON object is kept as text in a column of its own. Stored as parquet, variants keep their type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(record, bad): each line that is not blank as a variant, or as it stands if it is no object."""
    return records(spark.read.text(path).filter("trim(value) <> ''"), "value")


def records(df: DataFrame, text: str) -> DataFrame:
    """df with record, a variant, and bad, the text where there is none."""
    parsed = F.try_parse_json(F.col(text))
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    return df.withColumn("record", F.when(is_object, parsed)).withColumn("bad", F.when(~is_object, F.col(text))).drop(text)


def first(record: Column, kind: str, *paths: str) -> Column:
    """The value of the first path that has one of this type."""
    return F.coalesce(*[F.try_variant_get(record, p, kind) for p in paths])


def labels(df: DataFrame, record: str = "record") -> DataFrame:
    """Labels of single sources: the answer at the top, in `question`, or as a list of one in `question`."""
    r = F.col(record)
    return df.select(
        first(r, "string", "$.item_id").alias("item_id"),
        first(r, "string", "$.build_id", "$.build.id").alias("build_id"),
        first(r, "string", "$.answer_side", "$.question.answer_side").alias("answer_side"),
        first(r, "double", "$.answer_azimuth_deg", "$.question.answer_azimuth_deg", "$.question.answer_azimuths_deg[0]").alias("azimuth"),
        first(r, "string", "$.render.instrument", "$.instrument").alias("instrument"),
        F.try_variant_get(r, "$.measured_evidence", "variant").alias("evidence"),
    )


def mixture_labels(df: DataFrame, record: str = "record") -> DataFrame:
    """Labels of mixtures: a list of azimuths at the top or in `question`; a single azimuth is a list of one."""
    r = F.col(record)
    lists = first(r, "array<double>", "$.answer_azimuths_deg", "$.question.answer_azimuths_deg")
    one = first(r, "double", "$.answer_azimuth_deg", "$.question.answer_azimuth_deg")
    return df.select(first(r, "string", "$.item_id").alias("item_id"), F.coalesce(lists, F.when(one.isNotNull(), F.array(one))).alias("azimuths"), F.try_variant_get(r, "$.measured_evidence", "variant").alias("evidence"))


def measure(evidence: Column | str, name: str) -> Column:
    """A number of the evidence; null where it has none of that name."""
    return F.try_variant_get(F.col(evidence) if isinstance(evidence, str) else evidence, f"$.{name}", "double")


def entries(df: DataFrame, record: str, path: str, *keep: str) -> DataFrame:
    """A row for each entry of the object or list at a path: (keep, place, name, value), value as a variant. For reports, whose maps have
    any keys, and surveys, whose lists nest."""
    at = F.try_variant_get(F.col(record), path, "variant")
    source = df.select(*keep, at.alias("__at")).filter("__at IS NOT NULL")
    return source.lateralJoin(source.sparkSession.tvf.variant_explode(F.col("__at").outer())).select(*keep, F.col("pos").alias("place"), F.col("key").alias("name"), "value")
