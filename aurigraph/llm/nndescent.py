"""Near-duplicate vectors by NN-descent: a neighbour graph that is refined by joins of neighbours with neighbours.

1. Equal vectors become one node with a count. A node carries a sketch of its direction, a byte a component, which the search uses.
2. A pass starts from leaves: nodes are sorted by the signs of random projections, and those next to each other compare. Then come
   rounds: a node's neighbours and some of those that have it as theirs meet at it, and each pair of them is a candidate for the
   other's list. A list holds the NEIGHBOURS nearest; where it is saturated, all of them above the threshold, it grows to twice
   that length a round, up to MOST_NEIGHBOURS.
3. Edges above the threshold, less the sketch's error, give candidate components, and within each the links are counted exactly, in
   double precision. Small components are one block. Of a large one, the members within half the threshold's angle of its mean
   direction all link with each other, which needs no comparison; the others meet all members, block by block.
4. An audit compares AUDITED nodes with all vectors. While the links found fall short of GOAL of theirs, another pass with other
   projections refines the same graph.

So lists, leaves and rounds only decide what is found, never what is counted: of a component that the graph connects, no link is lost.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_batch, discard, meet, small_batches, stored
from .components import connected_components

MIN_COSINE = 0.9
NEIGHBOURS = 8
MOST_NEIGHBOURS = 64
REVERSE = 5
TREES = 8
LEAF = 50
#: Partners that a pair of lists, or a leaf, names for each of its members.
NAMED = 4
ROUNDS = 2
BLOCK = 128
AUDITED = 512
GOAL = 0.995
MOST_PASSES = 5
#: By how much the cosine of two sketches of up to 64 components can be less than that of the vectors.
SKETCH_ERROR = 0.07
#: Left of half the threshold's angle, so that rounding can't put a member into the core.
MARGIN = 1e-6


def directions(values: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square is too large or too small."""
    scaled = values / np.abs(values).max(1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def _plain(column: pa.Array) -> list[np.ndarray | None]:
    """Each vector as doubles, or None where it is null, empty, zero or holds a null or non-finite component."""
    found: list[np.ndarray | None] = []
    for v in column:
        x = np.array(v.values.to_numpy(zero_copy_only=False), np.float64) if v.is_valid else np.zeros(0)  # a null is NaN there
        found.append(x if len(x) and np.isfinite(x).all() and x.any() else None)
    return found


def sketch(unit: np.ndarray) -> bytes:
    """A byte for each component, then the scale as a float."""
    scale = np.float32(np.abs(unit).max() / 127)
    return np.rint(unit / scale).clip(-127, 127).astype(np.int8).tobytes() + scale.tobytes()


def marks(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, key, v): one row for each row; key, of 16 bytes, names the vector v (doubles, little-endian); both null if it links with nothing."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data = [None if x is None else (x + 0.0).astype("<f8").tobytes() for x in _plain(batch.column("v"))]
        keys = [None if d is None else hashlib.blake2b(d, digest_size=16).digest() for d in data]
        return pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(data, pa.binary())], names=["vec_id", "key", "v"])

    return by_batch(rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")), work, "vec_id long, key binary, v binary")


def nodes(found: DataFrame) -> DataFrame:
    """(node, key, first, n, v, q): each distinct vector, its least vec_id, its rows, its sketch."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        q = [sketch(directions(np.frombuffer(d, "<f8")[None])[0]) for d in batch.column("v").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(c) for c in ("node", "key", "first", "n", "v")] + [pa.array(q, pa.binary())], names=["node", "key", "first", "n", "v", "q"])

    once = found.filter("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"), F.first("v").alias("v"))
    numbered = once.select(F.monotonically_increasing_id().alias("node"), "key", "first", "n", "v")
    return by_batch(numbered, work, "node long, key binary, first long, n long, v binary, q binary")


def _sketches(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes times scale as floats, lengths): shorter sketches are filled up with zeros."""
    sizes = np.array([len(d) - 4 for d in data], np.int64)
    wide = int(sizes.max(initial=0))
    out = np.zeros((len(data), wide), np.float32)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        raw = np.frombuffer(b"".join(data[i] for i in at), np.uint8).reshape(len(at), size + 4)
        out[at, :size] = raw[:, :size].view(np.int8).astype(np.float32) * raw[:, size:].copy().view("<f4")
    return out, sizes


def best(ids: np.ndarray, vectors: np.ndarray, sizes: np.ndarray, least: np.ndarray | None = None, named: int = NAMED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(p, o, s): for each member p of each group the `named` most similar other members o, as far as they are above least.

    ids and sizes: groups x members, id -1 where a group is shorter; vectors: groups x members x components.
    """
    s = vectors @ vectors.transpose(0, 2, 1)
    bad = (ids[:, :, None] == ids[:, None, :]) | (ids < 0)[:, None, :] | (sizes[:, :, None] != sizes[:, None, :])
    s[bad] = -2
    k = min(named, s.shape[2])
    top = np.argpartition(-s, k - 1, axis=2)[:, :, :k]
    value = np.take_along_axis(s, top, 2)
    p = np.broadcast_to(ids[:, :, None], top.shape)
    o = np.take_along_axis(np.broadcast_to(ids[:, None, :], s.shape), top, 2)
    fine = (value > -2) & (p >= 0)
    if least is not None:
        fine &= value > least[:, :, None]
    p, o, value = p[fine], o[fine], value[fine]
    _, once = np.unique(np.stack([p, o]), axis=1, return_index=True)
    return p[once], o[once], value[once]


EDGES = "p long, o long, s float"


def _edges(found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float32())], names=["p", "o", "s"])


def leaves(points: DataFrame, trees: range, leaf: int = LEAF) -> DataFrame:
    """Candidate edges of nodes that lie next to each other in the order of the signs of 60 random projections; one order for each tree."""

    def codes(batch: pa.RecordBatch) -> pa.RecordBatch:
        vectors, sizes = _sketches(batch.column("q").to_pylist())
        made = []
        for tree in trees:
            code = np.zeros(len(vectors), np.int64)
            for size in np.unique(sizes):
                at = sizes == size
                planes = np.random.default_rng([tree, int(size)]).standard_normal((int(size), 60)).astype(np.float32)
                code[at] = ((vectors[at][:, :size] @ planes) > 0) @ (1 << np.arange(59, -1, -1, dtype=np.int64))
            made.append(pa.RecordBatch.from_arrays([pa.array(np.full(len(code), tree, np.int32)), pa.array(code), batch.column("node"), batch.column("q")], names=["tree", "code", "node", "q"]))
        return pa.Table.from_batches(made).combine_chunks().to_batches()[0]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column("node"))
            if not len(ids):
                continue
            vectors, sizes = _sketches(batch.column("q").to_pylist())
            groups = -(-len(ids) // leaf)
            each = -(-len(ids) // groups)
            spare = groups * each - len(ids)
            ids, sizes = np.pad(ids, (0, spare), constant_values=-1), np.pad(sizes, (0, spare))
            yield _edges(best(ids.reshape(groups, each), np.pad(vectors, ((0, spare), (0, 0))).reshape(groups, each, -1), sizes.reshape(groups, each)))

    placed = by_batch(points.select("node", "q"), codes, "tree int, code long, node long, q binary")
    return placed.repartitionByRange("tree", "code", "node").sortWithinPartitions("tree", "code", "node").mapInArrow(compare, EDGES)


def nearest(edges: DataFrame, longest: int, threshold: float, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(p, o, s, place): each node's list: its nearest, more of them (up to longest) where these are above the threshold as well."""
    order = Window.partitionBy("p").orderBy(F.col("s").desc(), "o")
    ranked = edges.withColumn("place", F.dense_rank().over(order)).filter(F.col("place") <= longest)
    return ranked.filter((F.col("place") <= neighbours) | (F.col("s") >= threshold - SKETCH_ERROR)).dropDuplicates(["p", "o"])


def local_join(graph: DataFrame, points: DataFrame, turn: int, neighbours: int = NEIGHBOURS, reverse: int = REVERSE) -> DataFrame:
    """Candidate edges between the neighbours of a node, and those that have it as theirs; of longer lists a share by hash each turn."""
    chance = F.xxhash64("p", "o", F.lit(turn))

    def some(by: str, most: int) -> DataFrame:
        return graph.withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy(chance))).filter(F.col("k") <= most)

    ahead = some("p", neighbours).select(F.col("p").alias("u"), F.col("o").alias("m"))
    behind = some("o", reverse).select(F.col("o").alias("u"), F.col("p").alias("m"))
    last = graph.filter(F.col("place") == neighbours).select(F.col("p").alias("m"), F.col("s").alias("least"))
    known = points.select(F.col("node").alias("m"), "q").join(last, "m", "left")
    met = ahead.unionByName(behind).join(known, "m").groupBy("u").agg(F.collect_list(F.struct("m", "q", "least")).alias("found"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("found")
            flat = column.flatten()
            if not len(flat):
                continue
            lengths = np.asarray(column.value_lengths())
            vectors, sizes = _sketches(flat.field("q").to_pylist())
            row, at = np.repeat(np.arange(len(lengths)), lengths), np.concatenate([np.arange(n) for n in lengths])
            wide = int(lengths.max())
            ids = np.full((len(lengths), wide), -1, np.int64)
            ids[row, at] = np.asarray(flat.field("m"))
            size = np.zeros((len(lengths), wide), np.int64)
            size[row, at] = sizes
            least = np.full((len(lengths), wide), -2.0, np.float32)
            least[row, at] = flat.field("least").fill_null(-2.0).to_numpy(zero_copy_only=False)
            padded = np.zeros((len(lengths), wide, vectors.shape[1]), np.float32)
            padded[row, at] = vectors
            yield _edges(best(ids, padded, size, least))

    return met.select("found").mapInArrow(compare, EDGES)


def descend(graph: DataFrame | None, points: DataFrame, turn: int, threshold: float, rounds: int = ROUNDS) -> DataFrame:
    """One pass: leaves of new projections, then rounds of local joins, into the graph that is there."""
    longest = NEIGHBOURS
    made = leaves(points, range(turn * TREES, (turn + 1) * TREES))
    now = stored(nearest(made if graph is None else made.unionByName(graph.select("p", "o", "s")), MOST_NEIGHBOURS if graph is not None else 2 * longest, threshold), "descent-graph")
    if graph is not None:
        discard(graph)
    for k in range(rounds):
        longest = min(2 * longest, MOST_NEIGHBOURS) if graph is None else MOST_NEIGHBOURS
        found = local_join(now, points, turn * rounds + k).unionByName(now.select("p", "o", "s"))
        then = stored(nearest(found, longest, threshold), "descent-graph")
        discard(now)
        now = then
    return now


def _means(members: DataFrame) -> DataFrame:
    """(comp, centre): the sum of the directions of each component's vectors."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        comps, x = np.asarray(batch.column("comp")), [np.frombuffer(d, "<f8") for d in batch.column("v").to_pylist()]
        keys, sums = [], []
        for c in np.unique(comps):
            keys.append(c)
            sums.append(directions(np.array([x[i] for i in np.flatnonzero(comps == c)])).sum(0))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([s.tolist() for s in sums], pa.list_(pa.float64()))], names=["comp", "part"])

    parts = by_batch(members.select("comp", "v"), work, "comp long, part array<double>")
    total = parts.select("comp", F.posexplode("part").alias("pos", "x")).groupBy("comp", "pos").agg(F.sum("x").alias("x"))
    return total.groupBy("comp").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda y: y["x"]).alias("centre"))


def _core(members: DataFrame, threshold: float) -> DataFrame:
    """(comp, node, n, v, core): whether the member lies within half the threshold's angle of its component's centre."""
    half = math.acos(threshold) / 2 - MARGIN

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        core = []
        for d, c in zip(batch.column("v").to_pylist(), batch.column("centre").to_pylist(), strict=True):
            c = np.array(c)
            length = np.sqrt(c @ c)
            core.append(bool(length > 0) and math.acos(min(1.0, max(-1.0, float(directions(np.frombuffer(d, "<f8")[None])[0] @ c / length)))) <= half)
        return pa.RecordBatch.from_arrays([batch.column(c) for c in ("comp", "node", "n", "v")] + [pa.array(core, pa.bool_())], names=["comp", "node", "n", "v", "core"])

    return by_batch(members.select("comp", "node", "n", "v", "centre"), work, "comp long, node long, n long, v binary, core boolean")


def block_links(mine: list[dict], theirs: list[dict], threshold: float) -> list[tuple[int, int, int]]:
    """(node, links, root) of the members of a block: linked rows of vectors, by count, and the least node that the block's links reach.

    theirs: empty if the block compares its members among themselves.
    """
    both = mine + theirs
    vectors = [np.frombuffer(r["v"], "<f8") for r in both]
    sizes = np.array([len(v) for v in vectors])
    unit = np.zeros((len(both), int(sizes.max())))
    for i, v in enumerate(vectors):
        unit[i, : len(v)] = directions(v[None])[0]
    hits = (unit @ unit.T >= threshold) & (sizes[:, None] == sizes[None, :])
    np.fill_diagonal(hits, False)
    if theirs:
        side = np.arange(len(both)) < len(mine)
        hits &= side[:, None] != side[None, :]
    ids, counts = np.array([r["node"] for r in both], np.int64), np.array([r["n"] for r in both], np.int64)
    links, label = hits @ counts, ids.copy()
    while True:
        least = np.minimum(label, np.where(hits, label[None, :], np.iinfo(np.int64).max).min(1))
        if (least == label).all():
            return list(zip(ids.tolist(), links.tolist(), label.tolist(), strict=True))
        label = least


def exact_links(graph: DataFrame, points: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(counts, joined): (node, links) of nodes with links to other nodes' rows, and (a, b): edges whose components are those of all links."""
    near = graph.filter(F.col("s") >= threshold - SKETCH_ERROR).select(F.col("p").alias("a"), F.col("o").alias("b"))
    groups = connected_components(near).select("node", F.col("component").alias("comp"))
    groups = stored(groups, "descent-groups")
    sizes = groups.groupBy("comp").agg(F.count("*").alias("size"))
    sized = meet(groups, sizes, "comp", "size", groups.count())
    members = stored(sized.join(points.select("node", "n", "v"), "node").select("comp", "size", "node", "n", "v"), "descent-members")
    small, large = members.filter(F.col("size") <= BLOCK), members.filter(F.col("size") > BLOCK)
    bounds = large.groupBy("comp").agg(F.count("*").alias("size"))
    centred = meet(large.drop("size"), _means(large).join(bounds, "comp"), "comp", "size", members.count())
    placed = stored(_core(centred, threshold), "descent-placed")
    totals = stored(
        placed.groupBy("comp").agg(F.sum(F.when(F.col("core"), F.col("n"))).alias("weight"), F.min(F.when(F.col("core"), F.col("node"))).alias("star"), F.count(F.when(F.col("core"), 1)).alias("cores"), F.count(F.when(~F.col("core"), 1)).alias("outs"), F.count("*").alias("size")),
        "descent-totals",
    )
    known = stored(meet(placed, totals, "comp", "size", members.count()), "descent-known")

    pieces = lambda n: F.ceil(F.col(n) / F.lit(BLOCK)).cast("int")
    of = lambda n: F.pmod(F.xxhash64("node"), F.greatest(pieces(n), F.lit(1))).cast("int")
    row = F.struct("node", "n", "v")
    apart = known.filter("outs > 0")
    outs = apart.filter("NOT core").withColumn("i", of("outs"))
    among = outs.withColumn("j", F.explode(F.sequence(F.lit(0), pieces("outs") - 1))).select("comp", F.lit("o").alias("kind"), F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), (F.col("i") <= F.col("j")).alias("mine"), row.alias("r"))
    to_core = outs.filter("cores > 0").withColumn("j", F.explode(F.sequence(F.lit(0), pieces("cores") - 1))).select("comp", F.lit("c").alias("kind"), F.col("i").alias("x"), F.col("j").alias("y"), F.lit(True).alias("mine"), row.alias("r"))
    from_core = apart.filter("core").withColumn("j", of("cores")).withColumn("i", F.explode(F.sequence(F.lit(0), pieces("outs") - 1))).select("comp", F.lit("c").alias("kind"), F.col("i").alias("x"), F.col("j").alias("y"), F.lit(False).alias("mine"), row.alias("r"))
    alone = small.select("comp", F.lit("o").alias("kind"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(True).alias("mine"), row.alias("r"))
    blocks = among.unionByName(to_core).unionByName(from_core).unionByName(alone).groupBy("comp", "kind", "x", "y").agg(F.collect_list(F.struct("mine", "r")).alias("found"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for found, within in zip(batch.column("found").to_pylist(), batch.column("within").to_pylist(), strict=True):
                mine, theirs = [f["r"] for f in found if f["mine"]], [f["r"] for f in found if not f["mine"]]
                if mine and (within or theirs):
                    out += block_links(mine, theirs, threshold)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], names=["node", "links", "root"])

    met = stored(blocks.select("found", ((F.col("kind") == "o") & (F.col("x") == F.col("y"))).alias("within")).mapInArrow(work, "node long, links long, root long"), "descent-met")
    within = known.filter("core").select("node", (F.col("weight") - F.col("n")).alias("links"), F.col("star").alias("root"))
    counts = stored(met.unionByName(within).groupBy("node").agg(F.sum("links").alias("links")).filter("links > 0"), "descent-counts")
    joined = met.unionByName(within).filter("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))
    return counts, joined


def audit(points: DataFrame, counts: DataFrame, threshold: float, audited: int = AUDITED, seed: int = 12) -> float:
    """Which part of the true links of `audited` nodes, chosen by hash, the counts hold; 1 if they have none."""
    chosen = points.select("node", "v").orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(audited).collect()
    if not chosen:
        return 1.0
    shared = points.sparkSession.sparkContext.broadcast([(r["node"], bytes(r["v"])) for r in chosen])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        total = np.zeros(len(shared.value), np.int64)
        data, n, ids = batch.column("v").to_pylist(), np.asarray(batch.column("n")), np.asarray(batch.column("node"))
        wanted = np.array([len(d) for _, d in shared.value])
        for size in {len(d) for d in data}:
            at, to = np.array([i for i, d in enumerate(data) if len(d) == size]), np.flatnonzero(wanted == size)
            if not len(to):
                continue
            x = directions(np.frombuffer(b"".join(data[i] for i in at), "<f8").reshape(len(at), -1))
            y = directions(np.frombuffer(b"".join(shared.value[i][1] for i in to), "<f8").reshape(len(to), -1))
            hits = (y @ x.T >= threshold) & (np.array([shared.value[i][0] for i in to])[:, None] != ids[at][None, :])
            total[to] += hits @ n[at]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in shared.value], pa.int64()), pa.array(total)], names=["node", "links"])

    true = by_batch(points.select("node", "n", "v"), work, "node long, links long").groupBy("node").agg(F.sum("links").alias("true"))
    both = true.join(counts, "node", "left").agg(F.sum("true"), F.sum(F.least("true", F.coalesce("links", F.lit(0))))).first()
    return both[1] / both[0] if both[0] else 1.0


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = MIN_COSINE, goal: float = GOAL, most_passes: int = MOST_PASSES) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row for each row of a table of vectors.

    n_links counts the other rows whose cosine with it is at least the threshold, equal vectors included; component_id is the least
    vec_id reachable by links, kept whether that is its own. Vectors that are null, empty, zero or hold a null or non-finite component
    link with nothing; vectors of different length don't link with each other. Repeated rows and ids give repeated rows, that link if
    their vectors do. A null id never names a component; alone, or among null ids only, the component is null and the row is kept.
    An empty table gives no rows. Other columns play no part.
    """
    small_batches(rows.sparkSession)
    found = stored(marks(rows, id_col, vector_col), "descent-marks")
    points = stored(nodes(found), "descent-nodes")
    graph = None
    for turn in range(most_passes):
        graph = descend(graph, points, turn, threshold)
        counts, joined = exact_links(graph, points, threshold)
        if audit(points, counts, threshold) >= goal:
            break
    groups = connected_components(joined)
    named = groups.join(points.select("node", "first"), "node")
    least = stored(named.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("size")), "descent-least")
    of = meet(groups, least, "component", "size", groups.count()).select("node", "component_id")
    linked = points.select("node", "key", "first", "n").join(counts, "node", "left").join(of, "node", "left").filter("links > 0 OR n > 1")
    known = stored(linked.select("key", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "first").alias("component_id"), F.lit(True).alias("linked")), "descent-known")
    back = meet(found.select("vec_id", "key"), known, "key", "n", found.count(), how="left")
    component = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("vec_id"))
    return back.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
