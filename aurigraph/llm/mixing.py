"""Mixing sources to target weights, on DataFrame functions only.

A source's size is its words. Targets share the whole by weight but stop at ``MOST`` times the source's size; what is above is
shared again by weight among the others until none is above. A document comes floor(rate) times, rate = target / size of its
source, plus once more with the fraction's probability, drawn from a hash of its id and a seed, so reruns agree.

Documents that are large beside their source (at least one part in ``LARGE`` of it, so fewer than that many a source) are not drawn
apart from each other: in order of size each adds the fraction to a sum that starts at a number drawn for the source, and the one that
takes it over a whole number comes once more. Each still has the fraction as its probability, but one large document more means one
fewer of the next. So taken words depart from the target by at most a large document's size and what small ones add by chance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, stored

WEIGHTS = (1.0, 2.0, 3.0)
MOST = 3.0
SEED = 20_260_101
LARGE = 2000


def words_in(text) -> F.Column:
    """How many runs of other than \\x20 and \\x09-\\x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(doc_id, seed: int = SEED) -> F.Column:
    """0 to 1 from the first 48 bits of sha256 of "seed:id", which any engine can repeat."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)


def _ranked(sources: DataFrame) -> DataFrame:
    """sources with a position from 0 by name in code point order, null last; counted by ranges of names, then within each."""
    spark = sources.sparkSession
    pieces = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = cut(sources.repartitionByRange(pieces, F.col("source").isNull(), F.col("source")).withColumn("piece", F.spark_partition_id()))
    sizes = {r["piece"]: r["n"] for r in ordered.groupBy("piece").agg(F.count("*").alias("n")).collect()}  # one number for each piece
    before, total = [], 0
    for piece in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(piece, 0)
    offset = F.element_at(F.array(*[F.lit(x).cast("long") for x in before or [0]]), F.col("piece") + 1)
    within = F.row_number().over(Window.partitionBy("piece").orderBy(F.col("source").asc_nulls_last()))
    return ordered.withColumn("position", offset + within - 1).drop("piece")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target, rate) from (source, source_size); rate is 0 where the source has no words.

    Rounds of sharing: sources whose share would be above the ceiling are set to it, the rest is shared by weight again.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("position") % len(weights) + 1).cast("int"))
    now = cut(_ranked(sources).withColumn("weight", weight).withColumn("ceiling", F.col("source_size") * F.lit(most)).withColumn("full", F.lit(False)))
    whole = now.agg(F.sum("source_size")).first()[0] or 0
    while True:
        held, spread, ended = now.agg(F.sum(F.when(F.col("full"), F.col("ceiling"))), F.sum(F.when(~F.col("full"), F.col("weight"))), F.count_if("full")).first()
        share = F.col("weight") * F.lit((float(whole) - (held or 0.0)) / spread if spread else 0.0)
        now = cut(now.withColumn("full", F.col("full") | (share > F.col("ceiling"))))
        if now.agg(F.count_if("full")).first()[0] == ended:
            break
    target = F.when(F.col("full"), F.col("ceiling")).otherwise(share)
    return now.select("source", "source_size", target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"))


def _rates(sized: DataFrame) -> DataFrame:
    """sized (source, size, ...) with source_size, target and rate.

    A source's rows are spread over many tasks by a salt before they meet its one row of rates, so a hot source is no one task.
    """
    per = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))))
    salts = 64
    salted = per.withColumnRenamed("source", "of").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = sized.withColumn("salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(salts)).cast("int"))
    return rows.join(salted, (rows["source"].eqNullSafe(salted["of"])) & (rows["salt"] == salted["salt"]), "left").drop("of", "salt")


def _is_large(size: F.Column, whole: F.Column) -> F.Column:
    return (size > 0) & (size * LARGE >= whole)


def _turns(large: DataFrame, seed: int) -> DataFrame:
    """large (source, doc_id, size, rate, ...) with `extra`, 1 for the documents whose fraction takes the sum over a whole number.
    Rows of one source, id and size are one document."""
    place = F.dense_rank().over(Window.partitionBy("source").orderBy("size", draw(F.col("doc_id"), seed), F.col("doc_id").asc_nulls_last()))
    start = draw(F.concat(F.lit("source:"), F.coalesce("source", F.lit(""))), seed)
    part = F.col("rate") - F.floor("rate")
    return large.withColumn("place", place).withColumn("extra", (F.floor(F.col("place") * part + start) - F.floor((F.col("place") - 1) * part + start)).cast("long")).drop("place")


def mixture(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, copies): one row for each row of docs with how often the mix takes it.

    Null and empty texts have size 0; a null source is one source, the last. Rows of one source, id and size are drawn alike. A source
    without words has target 0 and its documents no copies. An empty table gives no rows. Other columns play no part.
    """
    sized = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), words_in(F.col(text_col).cast("string")).alias("size")), "mixing-sizes")
    rated = _rates(sized)
    large = _is_large(F.col("size"), F.col("source_size"))
    part = F.col("rate") - F.floor("rate")
    drawn = rated.filter(~large).withColumn("extra", F.when(draw(F.col("doc_id"), seed) < part, 1).otherwise(0).cast("long"))
    return drawn.unionByName(_turns(rated.filter(large), seed)).select("doc_id", "size", "source_size", "target", (F.floor("rate") + F.col("extra")).cast("long").alias("copies"))


def mix(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with each row as often as the mix takes it; all columns of docs stay, whatever their names.

    Nulls, empty texts, repeated rows and sources without words are as in mixture(); an empty table gives no rows. The rates of the
    sources and the turns of large documents, not the documents, are what is joined: texts are read twice and shuffled never while these
    fit a checked broadcast (Spark's own threshold on the size of the written tables), and else shuffled, salted.
    """
    names = docs.columns
    text, source, doc_id = F.col(f"`{text_col}`").cast("string"), F.col(f"`{source_col}`").cast("string"), F.col(f"`{id_col}`").cast("long")
    sized = stored(docs.select(doc_id.alias("doc_id"), source.alias("source"), words_in(text).alias("size")), "mixing-sizes")
    rates = stored(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))).select("source", "source_size", "rate"), "mixing-rates")
    rated = sized.join(rates.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    turns = stored(_turns(rated.filter(_is_large(F.col("size"), F.col("source_size"))), seed).select("source", "doc_id", "size", "extra").distinct(), "mixing-turns")
    salts = 64
    packed = F.struct(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)])
    rows = docs.select(packed.alias("row"), source.alias("of"), doc_id.alias("id"), words_in(text).alias("words"), F.pmod(F.xxhash64(doc_id), F.lit(salts)).cast("int").alias("salt"))
    salted = rates.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = rows.join(salted, rows["of"].eqNullSafe(salted["source"]) & (rows["salt"] == salted["slot"])).drop("source", "slot", "salt")
    told = met.join(turns, met["of"].eqNullSafe(turns["source"]) & met["id"].eqNullSafe(turns["doc_id"]) & (met["words"] == turns["size"]), "left")
    part = F.col("rate") - F.floor("rate")
    taken = told.withColumn("copies", (F.floor("rate") + F.coalesce("extra", F.when(draw(F.col("id"), seed) < part, 1).otherwise(0))).cast("int")).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col(f"row.c{i}").alias(n) for i, n in enumerate(names)])
