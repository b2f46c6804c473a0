"""Near-duplicate documents by SimHash and deletion-variant signatures.

A fingerprint has 64 bits, one majority vote for each bit of the shingles' XXH64. Two fingerprints link when they differ
in at most ``MAX_BITS`` bits. A fingerprint is cut into two halves; of two that differ in at most two (or three) bits, one half
differs in at most one bit. So each half is indexed under its 32 variants with one bit struck out, an equality join finds the
candidates and counting the differing bits verifies them.

Only distinct fingerprints are indexed, so copies cost nothing. A bucket of two gives its pair straight from the aggregate;
one of up to ``DENSE`` members is paired, so a row meets a bounded number of others; a larger one is split by further
wildcards into cliques, each of which is one star. No link between components is lost at any size.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_batch, fresh, meet, stored, utf8
from .components import connected_components

WORDS = 3
SEED = 42
MAX_BITS = 2
#: Buckets with more distinct fingerprints than this are split by a second wildcard instead of being paired.
DENSE = 128
#: Ids that are broadcast at most.
BROADCAST_ROWS = 4_000_000


def fingerprint(data: bytes | None, words: int = WORDS, step: int = 1 << 16) -> int:
    """The unsigned 64-bit fingerprint; 0 for a text that is null or has no word."""
    w = (data or b"").lower().split()  # bytes: A-Z only, and exactly the white space \\x20 and \\x09-\\x0D
    if not w:
        return 0
    k = min(words, len(w))
    n, votes, digest = len(w) - k + 1, np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for start in range(0, n, step):
        part = w[start : min(start + step, n) + k - 1]
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = np.concatenate([[0], ends + 1])[: len(part) - k + 1]
        line = b" ".join(part)
        votes += _votes(np.array([digest(line[i:j], SEED) for i, j in zip(starts.tolist(), ends[k - 1 :].tolist())], np.uint64))
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def _votes(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255  # sums of up to 255 bits fit in a byte
    return bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[whole:].sum(0, dtype=np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, fp): one row for each row of docs; fp is the fingerprint as a signed long."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t, words) for t in utf8(batch.column("text"))], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], names=["doc_id", "fp"])

    return by_batch(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), work, "doc_id long, fp long")


def _apart(a, b):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _half(fp, second):
    return F.when(second, fp.bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned(fp, 32))


def _bit(position):
    return F.call_function("shiftleft", F.lit(1).cast("long"), position.cast("int"))


def variants(fps: DataFrame) -> DataFrame:
    """(key, fp): the 64 one-wildcard variants of the two halves; the key holds the half, the wildcard and the other bits."""
    v = F.col("v")
    half = _half(F.col("fp"), v >= 32)
    masked = half.bitwiseAND(F.bitwise_not(_bit(F.pmod(v, F.lit(32)))))
    return fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v")).select(F.call_function("shiftleft", v.cast("long"), F.lit(32)).bitwiseOR(masked).alias("key"), "fp")


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): links between distinct fingerprints whose components are those of all pairs within max_bits (2 or 3).

    The variants are shuffled once; a window over each bucket keeps the few that are not alone, which are stored.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("two halves find fingerprints that differ in 3 bits at most")
    pieces = max(1, int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bucket = Window.partitionBy("key")
    counted = variants(fps.repartition(pieces, "fp")).withColumn("n", F.count("*").over(bucket)).filter("n > 1").withColumn("a", F.min("fp").over(bucket))
    shared = stored(counted, "simhash-buckets")
    twos = shared.filter("n = 2 AND fp > a").select("a", F.col("fp").alias("b")).filter(_apart("a", "b") <= max_bits)
    small = shared.filter((F.col("n") > 2) & (F.col("n") <= DENSE)).select("key", "fp")
    pairs = small.select("key", F.col("fp").alias("a")).join(small.select("key", F.col("fp").alias("b")), "key").filter(F.col("a") < F.col("b")).filter(_apart("a", "b") <= max_bits).select("a", "b")
    return twos.unionByName(pairs).unionByName(_dense_links(shared.filter(F.col("n") > DENSE).select("key", "fp"), max_bits)).distinct()


def _dense_links(rows: DataFrame, max_bits: int) -> DataFrame:
    """Stars over crowded buckets; rows: (key, fp).

    Members differ in the struck half at its wildcard at most. Those that differ there differ in at most max_bits - 1 bits of
    the other half, the rest in at most max_bits. With that many wildcards in the other half, all members of a bucket are
    within max_bits of each other, so a star on the least of them links them and no pair need be verified.
    """
    second = F.col("key") >= F.lit(32 << 32)
    struck, other = _half(F.col("fp"), second), _half(F.col("fp"), ~second)
    differing = rows.select(F.col("key").alias("struck"), "fp", other.alias("other"), _masks(max_bits - 1).alias("masks")) if max_bits else None
    equal = rows.select(struck.bitwiseOR(F.when(second, F.lit(1 << 41)).otherwise(F.lit(1 << 40))).alias("struck"), "fp", other.alias("other"), _masks(max_bits).alias("masks")).distinct()
    spread = (differing.unionByName(equal) if max_bits else equal).select("struck", "fp", "other", F.explode("masks").alias("mask"))
    cliques = spread.select("struck", "mask", F.col("other").bitwiseAND(F.bitwise_not(F.col("mask"))).alias("rest"), "fp")
    least = cliques.groupBy("struck", "mask", "rest").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1")
    return cliques.join(least, ["struck", "mask", "rest"]).select("a", F.col("fp").alias("b")).filter(F.col("a") < F.col("b"))


def _masks(bits: int):
    return F.array(*[F.lit(sum(1 << p for p in chosen)).cast("long") for chosen in combinations(range(32), bits)])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id): one row for each row of docs.

    component_id is the smallest doc_id reachable over links. Null or wordless texts have fingerprint 0 and link as any other.
    Repeated rows and equal ids give repeated rows; a null id is kept and never names a component (if all are null, null).
    An empty table gives no rows. Other columns of docs play no part.
    """
    marks = stored(fingerprints(docs, id_col, text_col, words), "simhash-marks")
    nodes = stored(marks.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "simhash-nodes")
    groups = connected_components(links(nodes.select("fp"), max_bits))
    # the component's least doc_id, not its least fingerprint; a component of very many fingerprints is a hot key
    named = groups.join(nodes.select(F.col("fp").alias("node"), "first"), "node")
    least = stored(named.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("size")), "simhash-least")
    of = meet(groups, least, "component", "size", groups.count()).select(F.col("node").alias("fp"), "component_id")
    known = stored(nodes.join(of, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"), "n"), "simhash-known")
    return meet(marks, known, "fp", "n", marks.count()).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, max_bits: int = MAX_BITS, groups: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """docs with one row of each group of near duplicates, all columns kept: the one with the smallest id, nulls last.

    Where ids repeat or are null, rows are numbered first and the number settles what the id leaves open. The rows that go, of
    one number each, are broadcast as far as BROADCAST_ROWS of them, so that texts stay where they are, and shuffled beyond.
    groups finds (doc_id, component_id) of rows by a column of distinct ids; near_duplicates where it is not given.
    """
    groups = groups or (lambda rows, key: near_duplicates(rows, key, text_col, words, max_bits))
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    if ids.groupBy("id").count().filter("count > 1 OR id IS NULL").isEmpty():
        rows, key = docs, id_col
        losers = groups(docs, id_col).filter("doc_id <> component_id").select(F.col("doc_id").alias(id_col))
    else:
        key = fresh(docs, "row_number")
        rows = stored(docs.withColumn(key, F.monotonically_increasing_id()), "simhash-rows")
        found = groups(rows, key).join(rows.select(F.col(key).alias("doc_id"), F.col(id_col).alias("id")), "doc_id")
        winners = found.groupBy("component_id").agg(F.min_by("doc_id", F.struct(F.col("id").isNull(), "id", "doc_id")).alias("winner"))
        losers = found.join(winners.select(F.col("winner").alias("doc_id")), "doc_id", "left_anti").select(F.col("doc_id").alias(key))
    losers = stored(losers, "simhash-losers")
    return rows.join(F.broadcast(losers) if losers.count() <= BROADCAST_ROWS else losers, key, "left_anti").select(*docs.columns)
