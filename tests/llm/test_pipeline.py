from __future__ import annotations

import re

import corpus_pipeline as P

from aurigraph.llm import decontaminate, mixing, neardup, quality


def plain_groups(texts: dict[int, str | None]) -> dict[int, int]:
    """Components of texts that share 0.8 of their five-word shingles, by all pairs."""
    sets = {}
    for i, t in texts.items():
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        k = min(5, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    of = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            x, y = sets[a], sets[b]
            if a < b and of[a] != of[b] and len(x & y) >= 0.8 * len(x | y):
                low, high = sorted((of[a], of[b]))
                of = {i: low if c == high else c for i, c in of.items()}
    return of


def test_stages_on_a_small_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, items = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    good = {r.doc_id for r in quality.judge(docs, labels).filter("accepted").collect()}
    now = P.quality_filter(spark, docs, sf)
    assert {r.doc_id for r in now.collect()} == good and now.columns == docs.columns
    now = P.stored(now, "t1")
    groups = plain_groups({r.doc_id: r.text for r in now.collect()})
    assert groups == {r.doc_id: r.component_id for r in neardup.near_duplicates(now).collect()}
    after = P.stored(P.near_dedup(spark, now, sf), "t2")
    assert {r.doc_id for r in after.collect()} == set(groups.values()) and after.columns == docs.columns
    clean = P.stored(P.benchmark_decontamination(spark, after, sf), "t3")
    assert clean.columns == docs.columns
    assert decontaminate.contamination(clean, items).filter("size(spans) > 0").count() == 0
    copies = {r.doc_id: r.copies for r in mixing.mixture(clean).collect()}
    mixed = P.stored(P.source_mixing(spark, clean, sf), "t4")
    assert mixed.columns == docs.columns and mixed.count() == sum(copies.values())
    rows = P.sharded(spark, mixed, sf).collect()
    counts = [sum(r.shard == s for r in rows) for s in range(40)]
    assert len(rows) == mixed.count() and max(counts) - min(counts) <= 1


def test_stages_on_an_odd_table(spark, odd, empty):
    for n, start in enumerate((odd.select("doc_id", "text", "lang", "source", "n_chars"), empty.select("doc_id", "text", "lang", "source", "n_chars"))):
        sf = "/root/testdata/sf0.001"
        now = start
        for name, stage in P.STAGES:
            now = P.stored(stage(spark, now, sf), f"odd-{n}-{name}")
        assert now.count() <= 3 * 11
