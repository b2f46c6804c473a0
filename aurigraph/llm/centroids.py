"""Centroid clustering of embedding vectors: plain Lloyd on integers, the same on any number of partitions.

A component x counts as floor(``SCALE`` * x). Every round broadcasts the k centroids, mapInPandas finds each vector's nearest one
and yields sums for each centroid of its partition, and a groupBy by centroid and position merges those: k * 65 rows, whatever
the input. The vectors themselves are never shuffled; each pass reads them where they lie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

DIM = 64
CLUSTERS = 40
ROUNDS = 5
SCALE = 256
SEED = 2
#: Components from here on are left out: beyond, a squared distance of 64 components need not fit a long.
TOO_LARGE = float(2**19)
#: Vectors that are compared with a centroid at once.
BLOCK = 4096


def integers(vectors: pd.Series, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """(kept, values): which vectors are kept, and those as rows of integers. Nulls within a vector reach pandas as NaN."""
    made = np.array([v is not None and len(v) == dim for v in vectors], bool)
    x = np.array([np.asarray(v, np.float64) for v, ok in zip(vectors, made, strict=True) if ok], np.float64).reshape(-1, dim)
    fine = (np.abs(x) < TOO_LARGE).all(1)  # False for NaN, too
    made[made] = fine
    return made, np.floor(x[fine] * SCALE).astype(np.int64)


def nearest(values: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's nearest centroid, the least of equally near ones, and the squared distance to it."""
    which, least = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
    for start in range(0, len(values), BLOCK):
        x = values[start : start + BLOCK]
        far = np.empty((len(x), len(centroids)), np.int64)
        for k, c in enumerate(centroids):
            d = x - c
            far[:, k] = np.einsum("ij,ij->i", d, d)
        at = far.argmin(1)
        which[start : start + BLOCK], least[start : start + BLOCK] = at, far[np.arange(len(x)), at]
    return which, least


def _kept(df: DataFrame, vector: str, dim: int) -> DataFrame:
    return df.filter(F.size(vector) == dim)


def starting(rows: DataFrame, id_col: str, vector_col: str, k: int = CLUSTERS, dim: int = DIM, seed: int = SEED) -> np.ndarray:
    """The k kept vectors of the least sha256 of `seed:id`, in that order; of equal ids the lesser vector first. Fewer if there are fewer."""
    small = F.forall(F.col(vector_col), lambda x: x.isNotNull() & (F.abs(x.cast("double")) < TOO_LARGE))  # NaN is more than any number
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)
    whole = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    chosen = _kept(rows.filter(F.col(id_col).isNotNull()), vector_col, dim).filter(small).select(mark.alias("mark"), whole.alias("v")).orderBy("mark", "v").limit(k).collect()
    return np.array([r["v"] for r in chosen], np.int64).reshape(-1, dim)


def _sums(rows: DataFrame, centroids: np.ndarray, dim: int) -> list:
    """(cluster, pos, total) of the whole table; position 0 counts vectors, 1 sums distances, the others sum components."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = shared.value
        total = np.zeros((len(at), dim + 2), object)  # Python's integers: no partition is too large for them
        for batch in batches:
            _, values = integers(batch["v"], dim)
            which, far = nearest(values, at)
            part = np.zeros((len(at), dim + 2), np.int64)
            for k in np.unique(which):
                mine = which == k
                part[k] = [mine.sum(), 0, *values[mine].sum(0)]
                total[k, 1] += sum(far[mine].tolist())
            total += part.astype(object)
        used = [k for k in range(len(at)) if total[k, 0]]
        yield pd.DataFrame({"cluster": used, "sums": [[str(x) for x in total[k]] for k in used]}, columns=["cluster", "sums"])

    parts = rows.select("v").mapInPandas(run, "cluster int, sums array<string>")
    merged = parts.select("cluster", F.posexplode("sums").alias("pos", "x")).groupBy("cluster", "pos").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("total"))
    return merged.collect()


def lloyd(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, seed: int = SEED) -> tuple[np.ndarray, dict[int, int]]:
    """(centroids, inertia): the centroids after the rounds, and the sum of squared distances by cluster of the assignment after them."""
    small_batches(rows.sparkSession)
    at = starting(rows, id_col, vector_col, k, dim, seed)
    vectors = _kept(rows.select(F.col(vector_col).alias("v")), "v", dim)
    for turn in range(rounds + 1):
        if not len(at):
            return at, {}
        table = [[0] * (dim + 2) for _ in at]
        for r in _sums(vectors, at, dim):
            table[r["cluster"]][r["pos"]] = int(r["total"])
        if turn < rounds:
            at = np.array([[s // t[0] for s in t[2:]] if t[0] else list(c) for t, c in zip(table, at.tolist(), strict=True)], np.int64)
    return at, {c: t[1] for c, t in enumerate(table) if t[0]}


def _of(cluster: Column, values: dict[int, object], kind: str) -> Column:
    """The value of the cluster's number; null where it doesn't fit the type."""
    return F.element_at(F.create_map(*[F.lit(x) for c, v in values.items() for x in (c, str(v))]), cluster).try_cast(kind) if values else F.lit(None).cast(kind)


def clusters(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, seed: int = SEED) -> DataFrame:
    """(id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256): one row for each kept row of a table of vectors.

    Kept are vectors of exactly `dim` components, each neither null, NaN, infinite nor of magnitude 2**19 or more. Repeated rows count as
    often as they stand there. A row without an id is assigned but is no starting centroid. With fewer than k rows there are fewer
    centroids; where no kept row has an id, there is none and the result is empty. Ties go to the centroid of the smaller number; a
    centroid whose vectors have all left stays where it is. Other columns play no part.
    """
    at, inertia = lloyd(rows, id_col, vector_col, k, rounds, dim, seed)
    spark = rows.sparkSession
    marks = {c: hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for c, x in enumerate(at.tolist())}
    shared = spark.sparkContext.broadcast(at)
    source = _kept(rows.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).alias("v")), "v", dim)  # pandas would make a float of a long with nulls

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches if len(shared.value) else ():
            kept, values = integers(batch["v"], dim)
            which, far = nearest(values, shared.value)
            yield pd.DataFrame({"id": batch["id"][kept].to_numpy(), "cluster": which, "distance": far})

    assigned = source.mapInPandas(run, "id string, cluster int, distance long")
    return assigned.select(
        F.col("id").cast(rows.schema[id_col].dataType).alias(id_col),
        "cluster",
        "distance",
        _of(F.col("cluster"), inertia, "long").alias("cluster_inertia"),
        F.lit(str(sum(inertia.values()))).try_cast("long").alias("inertia"),
        _of(F.col("cluster"), marks, "string").alias("centroid_sha256"),
    )
