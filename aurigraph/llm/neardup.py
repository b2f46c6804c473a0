"""Near copies by exact similarity of word shingles; MinHash bands only find the candidates.

A document is its set of shingles of ``WORDS`` words. Two documents link when the Jaccard similarity of their sets is
``SIMILARITY`` or more. Each set has ``BANDS`` keys of ``ROWS`` least hashes; a pair at the limit shares no key with a chance
of (1 - 0.8 ** 5) ** 32, 3 in a million. Candidates are verified on their texts, so no link is below the limit.

Equal sets are one node, and pairs within one component are never looked at, as only components are asked for. The first candidates
are SimHash fingerprints that deletion-variant signatures link, as in op1; each is checked on the texts. Near copies may be many bits
apart, so bands find the rest. Every node is held against one hub, the one of least hash among all that share a bucket with it, which joins most of a family of
copies; then against the hub of each of its buckets that is in another component. What is still apart in a bucket of up to
``DENSE`` nodes is paired. In a larger one, the nodes outside its largest component are held against all its other nodes: they are
sent out in blocks of bounded size and the others stream past them, so that no pair but a link is ever a row. No link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import by_batch, discard, garbage_collected, meet, stored, utf8
from .components import connected_components

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
#: Buckets with more nodes than this are not paired but stream past the nodes outside their largest component.
DENSE = 64
#: UTF-8 bytes of texts that are sent out at once.
BLOCK_BYTES = 16 << 20
SEED = 42
#: Ids that are broadcast at most.
BROADCAST_ROWS = 4_000_000

_RANDOM = np.random.default_rng(SEED)
_TIMES = _RANDOM.integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, np.uint32)


def shingles(data: bytes | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of the runs of so many words, or of the whole of a shorter text."""
    w = (data or b"").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    k, digest = min(words, len(w)), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(w) - k + 1]
    line = b" ".join(w)
    return np.unique(np.array([digest(line[i:j], SEED) for i, j in zip(starts.tolist(), ends[k - 1 :].tolist())], np.uint64))


def band_keys(hashes: np.ndarray, step: int = 512) -> list[int]:
    """A signed key for each band; none for an empty set."""
    if not len(hashes):
        return []
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), step):
        np.minimum(least, (np.multiply.outer(low[i : i + step], _TIMES) + _PLUS).min(0), out=least)
    data, width = least.tobytes(), 4 * ROWS
    found = np.array([xxhash.xxh64_intdigest(data[b * width : (b + 1) * width], b) for b in range(BANDS)], np.uint64)
    return found.view(np.int64).tolist()


def _marks(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, same, size, keys, fp): `same` stands for the set, fp is the SimHash fingerprint as a signed long."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = utf8(batch.column("text"))
        sets, fps = [shingles(t, words) for t in texts], np.array([simhash.fingerprint(t) for t in texts], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([band_keys(s) for s in sets], pa.list_(pa.int64())), pa.array(fps)],
            names=["doc_id", "same", "size", "keys", "fp"],
        )

    return by_batch(docs, work, "doc_id long, same binary, size long, keys array<long>, fp long")


def _verified(pairs: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts are that similar."""
    pairs = stored(pairs, "neardup-pairs")
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "neardup-ids")
    few = ids.count() <= BROADCAST_ROWS
    texts = stored(docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi"), "neardup-texts")
    both = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        near = []
        for x, y in zip(utf8(batch.column("ta")), utf8(batch.column("tb"))):
            near.append(_near(shingles(x, words), shingles(y, words), similarity))
        return pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    found = stored(by_batch(both.select("a", "b", "ta", "tb"), work, "a long, b long"), "neardup-links")
    discard(pairs, ids, texts)
    return found


def _near(s: np.ndarray, t: np.ndarray, similarity: float) -> bool:
    common = len(np.intersect1d(s, t, assume_unique=True))
    return common >= similarity * (len(s) + len(t) - common)


def _streamed(rows: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b): links of the nodes that are `away` with nodes of other components in their buckets; rows: (key, node, component, away)."""
    own = rows.groupBy("node").agg(F.first("component").alias("component"), F.max("away").alias("away"), F.collect_list("key").alias("keys"), F.collect_list(F.when(F.col("away"), F.col("key"))).alias("away_keys"))
    ids = stored(own, "neardup-members")
    members = stored(docs.withColumnRenamed("doc_id", "node").join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "node"), "neardup-texts")
    parts = None
    for block in _blocks(members.filter("away").select("node", "component", "away_keys", "text")):
        known = [(node, component, shingles((text or "").encode(), words)) for node, component, _, text in block]
        by_key: dict[int, list[int]] = {}
        for i, (_, _, keys, _) in enumerate(block):
            for k in keys:
                by_key.setdefault(k, []).append(i)
        held = docs.sparkSession.sparkContext.broadcast((known, by_key))

        def work(batch: pa.RecordBatch, held=held) -> pa.RecordBatch:
            known, by_key = held.value
            a, b = [], []
            for node, component, keys, data in zip(*(batch.column(c).to_pylist() for c in ("node", "component", "keys")), utf8(batch.column("text"))):
                asked = {i for k in keys for i in by_key.get(k, ()) if known[i][1] != component}
                if asked:
                    s = shingles(data, words)
                    for i in asked:
                        t = known[i][2]
                        if min(len(s), len(t)) >= similarity * max(len(s), len(t)) and _near(s, t, similarity):
                            a.append(min(node, known[i][0]))
                            b.append(max(node, known[i][0]))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        part = stored(by_batch(members.select("node", "component", "keys", "text"), work, "a long, b long"), "neardup-links")
        held.destroy()
        parts = part if parts is None else parts.unionByName(part)
    return parts.distinct()


def _blocks(rows: DataFrame) -> Iterator[list[tuple]]:
    block, size = [], 0
    for row in rows.toLocalIterator():
        n = len((row["text"] or "").encode())
        if block and size + n > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append(tuple(row))
        size += n
    yield block


def signed_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b): candidates by deletion-variant signatures; nodes: (node, fp, ...). Nodes of one fingerprint are held against the least of
    them, and that against the least one of each fingerprint that is linked."""
    least = stored(nodes.groupBy("fp").agg(F.min("node").alias("least")), "neardup-fingerprints")
    same = nodes.join(least, "fp").filter(F.col("node") != F.col("least")).select(F.col("least").alias("a"), F.col("node").alias("b"))
    ends = [least.select(F.col("fp").alias(n), F.col("least").alias(f"node_{n}")) for n in ("a", "b")]
    apart = simhash.links(least.select("fp")).join(ends[0], "a").join(ends[1], "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    return same.unionByName(apart)


def components(nodes: DataFrame, docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(node, component) of the nodes that have a link; nodes: (node, size, keys, fp), docs: (doc_id, text) with each node's text."""
    bucket = Window.partitionBy("key")
    shared = nodes.select("node", "size", F.explode("keys").alias("key")).withColumn("n", F.count("*").over(bucket)).filter("n > 1")
    packed = stored(shared.groupBy("node").agg(F.first("size").alias("size"), F.collect_list("key").alias("keys")), "neardup-buckets")
    top = F.min(F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("hub"), F.col("size").alias("hub_size"), F.col("component").alias("hub_component"))).over(bucket)
    known = None

    def fits(a: str, b: str) -> F.Column:  # else the sets cannot be that similar
        return F.least(a, b) >= F.lit(similarity) * F.greatest(a, b)

    def rows() -> DataFrame:
        """(key, node, size, component) for each bucket of each node."""
        of = packed if known is None else packed.join(known, "node", "left")
        return of.select("node", "size", (F.lit(None).cast("long") if known is None else F.col("component")).alias("c"), F.explode("keys").alias("key")).select("key", "node", "size", F.coalesce("c", "node").alias("component"))

    def check(pairs: DataFrame) -> None:
        link(_verified(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), docs, words, similarity))

    def link(near: DataFrame) -> None:
        """The components with these links as well: what was known goes in as stars, not as all links found so far."""
        nonlocal known
        garbage_collected(docs.sparkSession)  # the shuffles of a pass go with it
        if near.isEmpty():
            return
        before = known
        stars = near if before is None else near.unionByName(before.filter("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b")))
        known = connected_components(stars)
        discard(*[t for t in (near, before) if t is not None])

    check(signed_pairs(nodes))
    one = rows().withColumn("top", top).groupBy("node", "size", "component").agg(F.min("top").alias("top")).select("node", "size", "component", "top.*")
    check(one.filter(F.col("component") != F.col("hub_component")).filter(fits("size", "hub_size")).select(F.col("node").alias("a"), F.col("hub").alias("b")))
    each = rows().withColumn("top", top).select("node", "size", "component", "top.*").filter(F.col("component") != F.col("hub_component"))
    check(each.filter(fits("size", "hub_size")).select(F.col("node").alias("a"), F.col("hub").alias("b")))
    # buckets that still hold several components
    open_ = rows().withColumn("n", F.count("*").over(bucket)).withColumn("low", F.min("component").over(bucket)).withColumn("high", F.max("component").over(bucket)).filter("low < high").select("key", "node", "size", "component", "n")
    apart = stored(open_, "neardup-apart")
    small = apart.filter(F.col("n") <= DENSE)
    x, y = (small.select("key", F.col("node").alias(n), F.col("size").alias(f"s{n}"), F.col("component").alias(f"c{n}")) for n in ("a", "b"))
    check(x.join(y, (x["key"] == y["key"]) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & fits("sa", "sb")).select("a", "b"))
    # the crowded ones
    large = rows().withColumn("n", F.count("*").over(bucket)).filter(F.col("n") > DENSE).withColumn("own", F.count("*").over(Window.partitionBy("key", "component")))
    tagged = stored(large.withColumn("top", F.max(F.struct("own", "component")).over(bucket)).filter(F.col("own") < F.col("n")).select("key", "node", "component", (F.col("component") != F.col("top.component")).alias("away")), "neardup-crowded")
    if not tagged.isEmpty():
        link(_streamed(tagged, docs, words, similarity))
    discard(packed, apart, tagged)
    return docs.sparkSession.createDataFrame([], "node long, component long") if known is None else known


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id) for each row of docs, whose ids are distinct and not null.

    component_id is the smallest id reachable over links. Null and wordless texts are all equal. Equal texts are one node. An empty
    table gives no rows. Other columns play no part.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marks = stored(_marks(plain, words), "neardup-marks")
    firsts = stored(marks.groupBy("same").agg(F.min("doc_id").alias("node")), "neardup-nodes")
    nodes = marks.join(firsts.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "size", "keys", "fp")
    groups = components(nodes, plain, words, similarity)
    sized = marks.groupBy("same").agg(F.count("*").alias("n"))
    known = stored(firsts.join(groups, "node", "left").join(sized, "same").select("same", F.coalesce("component", "node").alias("component_id"), "n"), "neardup-known")
    return meet(marks, known, "same", "n", marks.count()).select("doc_id", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each group of near copies, all columns kept, chosen as by simhash.one_of_each."""
    return simhash.one_of_each(docs, id_col, text_col, groups=lambda rows, key: near_duplicates(rows, key, text_col, words, similarity))
