"""Operators that work in passes or pieces, against plain versions."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from aurigraph.operators import collect as C
from aurigraph.operators import joins as J
from aurigraph.operators import quantiles as Q
from aurigraph.operators import recurrences as R
from aurigraph.operators import signals as K

NAN, INF = float("nan"), float("inf")


def plain_quantile(values: list, p: float) -> float | None:
    kept = sorted((x for x in values if x is not None), key=lambda x: (x != x, x))
    if not kept:
        return None
    k = p * (len(kept) - 1)
    low, high = kept[math.floor(k)], kept[math.ceil(k)]
    return low if low == high else low + (k - math.floor(k)) * (high - low)


@pytest.mark.parametrize("limit", [100_000, 60])
def test_quantiles(spark, limit):
    """Even and odd numbers, ties, few values many times, nulls, NaN, infinities, null keys."""
    r = random.Random(2)
    rows = [("a", r.gauss(0, 1)) for _ in range(3001)] + [("b", float(r.randrange(5))) for _ in range(2000)] + [("c", 1.0), ("c", 2.0), ("d", None), (None, 5.0), (None, 6.0)]
    rows += [("e", NAN), ("e", 1.0), ("e", None), ("f", INF), ("f", -INF), ("f", 0.0)] + [("g", r.choice([NAN, r.random(), 7.0])) for _ in range(1500)]
    at = {"none": 0.0, "low": 0.025, "median": 0.5, "high": 0.975, "all": 1.0}
    found = Q.quantiles(spark.createDataFrame(rows, "k string, v double").repartition(4), "v", at, "k", limit=limit).collect()
    assert {x.k for x in found} == {k for k, _ in rows} and len(found) == 8
    for row in found:
        for name, p in at.items():
            assert row[name] == pytest.approx(plain_quantile([v for k, v in rows if k == row.k], p), nan_ok=True), (row.k, name)


def test_quantiles_of_nothing(spark):
    none = spark.createDataFrame([], "k string, v double")
    assert [tuple(r) for r in Q.median(none, "v").collect()] == [(None,)] and Q.median(none, "v", "k").collect() == []


def test_interval_join(spark):
    r = random.Random(1)
    spans = [(i, *sorted([r.uniform(-50, 50), r.uniform(-50, 50)])) for i in range(60)] + [(60, None, 3.0), (61, 5.0, None), (62, None, None), (63, 2.0, 1.0), (64, 7.0, 7.0), (65, -1e300, 1e300), (66, INF, None), (67, 7.0, 9.0)]
    points = [(i, r.uniform(-60, 60)) for i in range(300)] + [(300, 7.0), (301, None), (302, NAN), (303, INF), (304, -1e18), (305, 9.0)]

    def holds(v, low, high):
        if v is None or (low is not None and high is not None and low > high):
            return False
        return (low is None or v != v or v >= low) and (high is None or (v == v and v <= high))

    want = {(p, i) for p, v in points for i, low, high in spans if holds(v, low, high)}
    ranges = spark.createDataFrame(spans, "span_id int, low double, high double")
    for unit in (1e-3, 10.0):
        met = J.in_ranges(spark.createDataFrame(points, "level int, v double"), ranges, "v", "low", "high", unit)
        got = [(x.level, x.span_id) for x in met.collect()]
        assert len(got) == len(set(got)) and set(got) == want
    widest = ranges.filter("span_id < 60").select(F.size(J.dyadic(J._cell(F.col("low"), 1e-3), J._cell(F.col("high"), 1e-3))).alias("n")).agg(F.max("n")).first()[0]
    assert widest <= 2 * math.log2(100 / 1e-3)


def test_blocks_cover_a_range_once(spark):
    cells = spark.range(70).crossJoin(spark.range(70).withColumnRenamed("id", "to")).filter("id <= to")
    blocks = cells.select("id", "to", F.explode(J.dyadic(F.col("id"), F.col("to"))).alias("b"))
    covered = blocks.select("id", "to", F.explode(F.sequence(F.col("b.block") * F.pow(F.lit(2), "b.level").cast("long"), (F.col("b.block") + 1) * F.pow(F.lit(2), "b.level").cast("long") - 1)).alias("c"))
    checked = covered.groupBy("id", "to").agg(F.count("*").alias("n"), F.countDistinct("c").alias("d"), F.min("c").alias("low"), F.max("c").alias("high"))
    assert checked.count() == 70 * 71 // 2 and checked.filter("n <> d OR n <> to - id + 1 OR low <> id OR high <> to").isEmpty()


@pytest.fixture(scope="module")
def signals():
    rng = np.random.default_rng(0)
    return {i: rng.standard_normal(n) for i, n in enumerate((1, 50, 1000))}


@pytest.mark.parametrize("stretch", [16, 700, 10**6])
def test_a_filter_does_not_see_where_a_signal_is_cut(spark, signals, stretch):
    c = [1.02, -1.9, 0.95, -1.9, 0.97]
    frame = spark.createDataFrame([(i, x.tolist(), c) for i, x in signals.items()], "k int, x array<double>, c array<double>")
    found = R.whole(R.biquad(R.cut(frame, "k", "x", stretch).join(frame.select("k", "c"), "k"), "k"), "k")
    for row in found.collect():
        x, y = np.concatenate([[0, 0], signals[row.k]]), [0.0, 0.0]
        for t in range(2, len(x)):
            y.append(c[0] * x[t] + c[1] * x[t - 1] + c[2] * x[t - 2] - c[3] * y[t - 1] - c[4] * y[t - 2])
        assert row.y == pytest.approx(y[2:], abs=1e-9)


@pytest.mark.parametrize("stretch", [64, 10**6])
def test_a_compressor_does_not_see_where_a_signal_is_cut(spark, signals, stretch):
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in signals.items()], "k int, x array<double>")
    for row in R.whole(R.compressor(R.cut(frame, "k", "x", stretch), "k", 0.1, 4.0, 0.5, 0.9), "k").collect():
        now, want = 0.0, []
        for v in signals[row.k]:
            target = max(v - 0.1, 0.0) * 0.75
            c = 0.5 if target > now else 0.9
            now = c * now + (1 - c) * target
            want.append(now)
        assert row.y == want


def test_running_sums(spark, signals):
    frame = spark.createDataFrame([(i, t, float(v)) for i, x in signals.items() for t, v in enumerate(x)], "k int, pos int, v double")
    found = {(r.k, r.pos): r.total for r in R.running_sum(frame, "k", "pos", "v", 64).collect()}
    assert all(found[i, t] == pytest.approx(v, abs=1e-9) for i, x in signals.items() for t, v in enumerate(np.cumsum(x)))


def test_separated_angles_are_even_and_exact(spark):
    grid = [float(a) for a in range(-25, 30, 5)]
    asked = spark.range(3000).select(F.col("id").alias("p"), (F.col("id") % 9).cast("int").alias("n"))
    seen: dict[tuple, int] = {}
    for r in C.separated_angles(asked, "p", "n", grid, 3).collect():
        assert r.angles == (C.pick_separated(str(r.p), r.n, grid, 3) if r.n else []), r
        if r.n == 2:
            seen[tuple(r.angles)] = seen.get(tuple(r.angles), 0) + 1
    assert len(seen) == 45 and max(seen.values()) < 25  # of 333 draws among 45
    uneven = C.separated_angles(asked.filter("n BETWEEN 1 AND 3"), "p", "n", [0.0, 4.0, 10.0, 13.0, 50.0], 3).collect()
    assert all(b - a >= 10 for r in uneven for a, b in zip(r.angles, r.angles[1:])) and {tuple(r.angles) for r in uneven if r.n == 3} == {(0.0, 10.0, 50.0), (0.0, 13.0, 50.0)}


@pytest.mark.parametrize("most", [4096, 50])
def test_ridge_by_rows_and_by_moments(spark, monkeypatch, most):
    """Many small groups and a large one, each fitted without itself."""
    monkeypatch.setattr(K, "GROUP_ROWS", most)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 4))
    y = x @ np.array([1.0, -2.0, 0.5, 3.0]) + 2 + rng.normal(size=400) * 0.1
    g = np.where(np.arange(400) < 150, 0, np.arange(400) % 90 + 1)
    rows = spark.createDataFrame([(i, x[i].tolist(), float(y[i]), int(g[i])) for i in range(400)], "id long, x array<double>, y double, g long").repartition(5)
    got = {r.key: r.predicted for r in K.leave_one_group_out(rows, "id", "x", "y", "g", 0.7).collect()}
    assert len(got) == 400
    for one in set(g.tolist()):
        on = g != one
        xc, yc = x[on] - x[on].mean(0), y[on] - y[on].mean()
        w = np.linalg.solve(xc.T @ xc + 0.7 * np.eye(4), xc.T @ yc)
        for i in np.flatnonzero(~on):
            assert got[int(i)] == pytest.approx((x[i] - x[on].mean(0)) @ w + y[on].mean())


def exchanged(df) -> list[list[str]]:
    """The columns that each shuffle by key moves."""
    plan, found = df._jdf.queryExecution().executedPlan(), []
    todo = [plan.initialPlan() if "Adaptive" in plan.nodeName() else plan]
    while todo:
        p = todo.pop()
        if "Exchange" in p.nodeName() and "hash" in p.outputPartitioning().toString():
            found.append([p.output().apply(k).name() for k in range(p.output().size())])
        todo += [p.children().apply(k) for k in range(p.children().size())]
    return found


@pytest.mark.parametrize("order", [None, "n"])
def test_answers_are_read_before_they_move(spark, order):
    from aurigraph.operators import score as S

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        items = spark.range(50).select(F.col("id").alias("item_id"), F.lit(5.0).alias("azimuth"))
        answers = spark.range(50).select(F.col("id").alias("item_id"), F.concat(F.lit("at 5 degrees left "), F.col("id").cast("string")).alias("answer"), F.lit(1).alias("n"))
        moved = exchanged(S.score(items, answers, order))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert moved and all("answer" not in columns for columns in moved), moved
