"""Centroids, NN-descent and retention against brute force."""

from __future__ import annotations

import datetime
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from aurigraph.llm import centroids, cohorts, nndescent

VECTORS = "vec_id long, embedding array<float>, cluster string, node int, n string"


def vector_rows(n: int, dim: int, seed: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    return [(i, rng.standard_normal(dim).astype(np.float32).tolist(), "c", 1, "n") for i in range(n)]


def odd_vectors(dim: int) -> list[tuple]:
    one = [0.25] * dim
    return [
        (900, None, "c", 1, "n"), (901, [], "c", 1, "n"), (902, [0.0] * dim, "c", 1, "n"), (903, [float("nan")] + one[1:], "c", 1, "n"), (904, [None] + one[1:], "c", 1, "n"),
        (905, [float("inf")] + one[1:], "c", 1, "n"), (906, one[1:], "c", 1, "n"), (907, one, "c", 1, "n"), (907, one, "c", 1, "n"), (None, one, "c", 1, "n"), (None, [x * 3 for x in one], "c", 1, "n"),
        (908, [1e-30] * dim, "c", 1, "n"), (909, [1e30] * dim, "c", 1, "n"),
    ]


def usable(v, dim: int | None = None) -> bool:
    return v is not None and len(v) > 0 and (dim is None or len(v) == dim) and all(x is not None and math.isfinite(x) for x in v)


def lloyd_by_hand(rows: list[tuple], k: int, rounds: int, dim: int, seed: int):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, *_ in rows if usable(v, dim) and all(abs(x) < 2**19 for x in v)]
    start = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    at = [v for _, v in start]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(at))

    for _ in range(rounds):
        mine = [near(v)[1] for _, v in kept]
        for j in range(len(at)):
            own = [v for (_, v), m in zip(kept, mine, strict=True) if m == j]
            if own:
                at[j] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    found = [(i, near(v)) for i, v in kept]
    inertia = {}
    for _, (d, j) in found:
        inertia[j] = inertia.get(j, 0) + d
    return [(i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, at[j])).encode()).hexdigest()) for i, (d, j) in found]


def test_centroids_by_hand(spark):
    rows = vector_rows(150, 6, 3) + odd_vectors(6) + [(1000 + i, [0.5, -0.5, 0.5, -0.5, 0.5, -0.5], "c", 1, "n") for i in range(5)]
    frame = spark.createDataFrame(rows, VECTORS).repartition(5)
    for k, rounds in ((7, 3), (300, 2), (1, 1)):
        found = centroids.clusters(frame, k=k, rounds=rounds, dim=6)
        assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(map(repr, lloyd_by_hand(rows, k, rounds, 6, 2)))


def test_centroids_without_rows(spark):
    assert centroids.clusters(spark.createDataFrame([], VECTORS), dim=6).collect() == []
    assert centroids.clusters(spark.createDataFrame([(None, [1.0] * 6, "c", 1, "n"), (1, None, "c", 1, "n")], VECTORS), dim=6).collect() == []


def test_nearest_takes_the_smaller_number_of_equally_near_ones():
    which, far = centroids.nearest(np.array([[0, 0], [4, 0]]), np.array([[2, 0], [-2, 0], [2, 0]]))
    assert which.tolist() == [0, 0] and far.tolist() == [4, 4]


def links_by_hand(rows: list[tuple], threshold: float):
    units = []
    for _, v, *_ in rows:
        x = np.array(v, np.float64) if usable(v) and any(v) else None
        units.append(None if x is None else nndescent.directions(x[None])[0])
    linked = [[i != j and a is not None and b is not None and len(a) == len(b) and float(a @ b) >= threshold for j, b in enumerate(units)] for i, a in enumerate(units)]
    component = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, row in enumerate(linked):
            for j, yes in enumerate(row):
                if yes and component[i] != component[j]:
                    component[i] = component[j] = min(component[i], component[j])
                    changed = True
    out = []
    for i, (vec_id, *_) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if component[j] == component[i] and rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((vec_id, sum(linked[i]), least, vec_id == least))
    return sorted(map(repr, out))


def near_copies(base: np.ndarray, n: int, noise: float, first: int, rng) -> list[tuple]:
    return [(first + i, (base + noise * rng.standard_normal(len(base))).tolist(), "c", 1, "n") for i in range(n)]


@pytest.mark.parametrize("block", [128, 8])
def test_near_vectors_by_hand(spark, monkeypatch, block):
    """A dense group with stragglers, chains whose ends don't link, pairs, copies, odd rows; with small blocks the group is cut up."""
    monkeypatch.setattr(nndescent, "BLOCK", block)
    rng = np.random.default_rng(8)
    rows = vector_rows(120, 16, 4)
    rows += near_copies(rng.standard_normal(16), 40, 0.05, 300, rng)
    loose = rng.standard_normal(16)
    rows += near_copies(loose, 30, 0.32, 400, rng) + near_copies(loose, 12, 0.05, 450, rng)
    a, b = (x / np.linalg.norm(x) for x in rng.standard_normal((2, 16)))
    b = b - (a @ b) * a
    b /= np.linalg.norm(b)
    rows += [(500 + i, (math.cos(0.35 * i) * a + math.sin(0.35 * i) * b).tolist(), "c", 1, "n") for i in range(12)]
    rows += [(600, rows[0][1], "c", 1, "n"), (601, [2 * x for x in rows[0][1]], "c", 1, "n"), (602, rows[5][1][:8], "c", 1, "n")]
    rows += odd_vectors(16)
    found = nndescent.near_duplicates(spark.createDataFrame(rows, VECTORS).repartition(4))
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(repr, (tuple(r) for r in found.collect()))) == links_by_hand(rows, 0.9)


def test_near_vectors_of_empty_and_unlinkable_tables(spark):
    assert nndescent.near_duplicates(spark.createDataFrame([], VECTORS)).collect() == []
    found = nndescent.near_duplicates(spark.createDataFrame([(1, None, "c", 1, "n"), (None, [0.0] * 4, "c", 1, "n")], VECTORS))
    assert sorted(map(repr, (tuple(r) for r in found.collect()))) == [repr((1, 0, 1, True)), repr((None, 0, None, True))]


def test_saturated_lists_grow(spark):
    edges = spark.createDataFrame([(1, o, 0.99) for o in range(10, 40)] + [(2, o, 0.5) for o in range(10, 40)], nndescent.EDGES)
    lists = {r["p"]: r["count"] for r in nndescent.nearest(edges, 16, 0.9).groupBy("p").count().collect()}
    assert lists == {1: 16, 2: nndescent.NEIGHBOURS}


CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, start string, n int"
CLIENTS = "client_id long, source string, segment string, n int"


def click_rows(seed: int) -> list[tuple]:
    r = random.Random(seed)
    t0 = datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(700):
        ts = t0 + datetime.timedelta(microseconds=r.randrange(150 * 86_400_000_000))
        client = 1 if r.random() < 0.33 else r.randrange(2, 30)
        rows.append((i, ts, ts + datetime.timedelta(minutes=r.randrange(60)), client, r.choice(["error", "view", "view", "click", None]), r.choice([None, 1.005, 2.5, -3.3, float("nan"), float("inf"), 12.34]), r.choice([None, "", "{}"]), "s", 1))
    rows += rows[:40]
    when = datetime.datetime(2024, 1, 10, 3)
    rows += [(5, None, when, 3, "error", 1.0, "{}", "s", 1), (6, when, when, None, "error", 1.0, "{}", "s", 1), (None, when, when, 31, "error", 1.0, None, "s", 1), (800, when, None, 31, "view", 1.0, "a", "s", 1), (800, when, None, 31, "view", 1.0, "b", "s", 1)]
    rows += [(900 + k, when, when, 40 + k, "error", 1.0, "{}", "s", 1) for k in range(20)]  # at their own start
    spring = datetime.datetime(2024, 3, 10, 2, 30)  # no such hour on a New York clock
    rows += [(950, spring, spring, 70, "error", 1.0, "{}", "s", 1), (951, spring + datetime.timedelta(days=7), spring, 70, "view", 1.0, "{}", "s", 1), (952, spring + datetime.timedelta(days=7, microseconds=-1), spring, 70, "view", 1.0, "{}", "s", 1)]
    return rows


def retention_by_hand(clicks: list[tuple], clients: list[tuple]) -> list[str]:
    epoch, cutoff = datetime.datetime(1970, 1, 1), datetime.datetime(2024, 2, 1)
    us = lambda t: (t - epoch) // datetime.timedelta(microseconds=1)
    once = {repr(c): c for c in clicks}.values()
    seen = []
    for click_id, ts, arrived, client, kind, value, *_ in once:
        if ts is None or client is None:
            continue
        h = zlib.crc32(str(click_id).encode()) if click_id is not None else 1
        at = None if arrived is None else arrived + datetime.timedelta(days=h % 100 if h % 3 == 0 else 0)
        cents = math.floor(100 * value + 0.5) if value is not None and math.isfinite(value) else 0
        seen.append((client, us(ts), kind == "error", cents, at is not None and at < cutoff))
    sources: dict = {}
    for client, source, *_ in clients:
        if source is not None:
            sources[client] = min(source, sources.get(client, source))
    states = [[s for s in seen if s[4]], seen]
    starts = [{}, {}]
    for known, start in zip(states, starts, strict=True):
        for client, t, error, *_ in known:
            if error:
                start[client] = min(t, start.get(client, t))
    cohort = lambda t: t // 86_400_000_000 // 7
    cells: dict = {}
    for state in (0, 1):
        for client, t, _, cents, _ in states[state]:
            begun = starts[state].get(client)
            if begun is None or t < begun:
                continue
            cell = cells.setdefault((state, sources.get(client, ""), cohort(begun), (t - begun) // (7 * 86_400_000_000)), [set(), 0])
            cell[0].add(client)
            cell[1] += cents
    out = []
    for (state, segment, c, period), (users, cents) in cells.items():
        moved = sum(u in starts[0] and u in starts[1] and cohort(starts[0][u]) != cohort(starts[1][u]) for u in users)
        out.append(repr((state, segment, c, period, len(users), sum(zlib.crc32(str(u).encode()) for u in users), moved, cents)))
    return sorted(out)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_retention_by_hand(spark, zone):
    clicks, clients = click_rows(5), [(c, random.Random(c).choice(["web", "crm", None]), "x", 1) for c in range(2, 50)] + [(3, "aaa", "x", 1), (None, "web", "x", 1), (99, "web", "x", 1)]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        found = cohorts.retention(spark.createDataFrame(clicks, CLICKS).repartition(3), spark.createDataFrame(clients, CLIENTS))
        assert found.columns == ["state", "segment", "cohort", "period", "users", "users_crc32", "moved", "cents"]
        rows = [tuple(r) for r in found.collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert sorted(map(repr, rows)) == retention_by_hand(clicks, clients)
    assert any(r[6] for r in rows if r[0] == 0) and any(r[6] for r in rows if r[0] == 1)


def test_retention_of_empty_tables(spark):
    none, clients = spark.createDataFrame([], CLICKS), spark.createDataFrame([], CLIENTS)
    assert cohorts.retention(none, clients).collect() == []
    clicks = click_rows(6)
    assert sorted(repr(tuple(r)) for r in cohorts.retention(spark.createDataFrame(clicks, CLICKS), clients).collect()) == retention_by_hand(clicks, [])


def test_deltas_leave_untouched_clients_alone(spark):
    """Only clients of late rows have deltas, and only those whose start moves are retracted."""
    clicks = click_rows(7)
    known = cohorts.events(spark.createDataFrame(clicks, CLICKS)).cache()
    early, late = known.filter("NOT late"), known.filter("late")
    people = cohorts.starts(early)
    named = cohorts.segments(spark.createDataFrame([], CLIENTS))
    begun = people.filter("start IS NOT NULL").join(named, "client_id", "left").fillna("", ["segment"])
    state0 = cohorts.contributions(early, begun, early.count())
    changes = cohorts.deltas(state0, people, late, known, named).collect()
    of_late = {r["client_id"] for r in late.collect()}
    assert {r["client_id"] for r in changes} <= of_late
    starts0, starts1 = ({r["client_id"]: r["start"] for r in cohorts.starts(x).collect()} for x in (early, known))
    assert {r["client_id"] for r in changes if r["sign"] < 0} == {c for c in of_late if starts0.get(c) is not None and starts1[c] < starts0[c]}
    known.unpersist()
