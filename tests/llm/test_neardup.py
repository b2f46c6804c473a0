from __future__ import annotations

import random

import corpus_pipeline as P
import pytest
from aurigraph.llm import neardup, simhash
from pyspark.sql import functions as F


def _shingles(text: str) -> set[str]:
    w = text.lower().split()
    k = min(5, len(w))
    return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def _similar(a: str, b: str) -> float:
    x, y = _shingles(a), _shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def _planted() -> dict[int, str]:
    """Families of texts of which some words are changed, unrelated texts, and texts without words."""
    rng, texts = random.Random(5), []
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    for size in (40, 120, 300):
        base = [word() for _ in range(size)]
        for _ in range(12):
            own = list(base)
            for _ in range(rng.randrange(1 + size // 40)):
                own[rng.randrange(size)] = word()
            texts.append(" ".join(own))
        texts.append(" ".join(base).upper())
    texts += [" ".join(word() for _ in range(50)) for _ in range(10)] + ["", " \n", "one two", "ONE two"]
    rng.shuffle(texts)
    return dict(enumerate(texts))


def _components(texts: dict[int, str]) -> dict[int, int]:
    of = {i: i for i in texts}
    for a in texts:
        for b in texts:
            if a < b and of[a] != of[b] and _similar(texts[a], texts[b]) >= 0.8:
                low, high = sorted((of[a], of[b]))
                of = {i: low if c == high else c for i, c in of.items()}
    return of


@pytest.mark.parametrize("dense", [64, 3])
def test_near_copies_are_brute_force(spark, monkeypatch, dense):
    monkeypatch.setattr(neardup, "DENSE", dense)
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 2000)
    texts = _planted()
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(rows).collect()} == _components(texts)


def test_stage_drops_planted_near_copies(spark):
    texts = _planted()
    far = [(a, b) for a in texts for b in texts if a < b and _similar(texts[a], texts[b]) >= 0.8 and (simhash.fingerprint(texts[a].encode()) ^ simhash.fingerprint(texts[b].encode())).bit_count() > 2]
    assert far  # more bits apart than op1 links
    rows = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = P.near_dedup(spark, rows, "")
    assert kept.columns == rows.columns
    assert {r.doc_id for r in kept.collect()} == set(_components(texts).values())


def test_signatures_find_candidates_of_the_stage(spark, monkeypatch):
    """Near copies within op1's bits are found without any band, and a link of fingerprints alone is none."""
    monkeypatch.setattr(neardup, "band_keys", lambda hashes: [])
    texts = _planted()
    bits = lambda a, b: (simhash.fingerprint(texts[a].encode()) ^ simhash.fingerprint(texts[b].encode())).bit_count()
    near = [(a, b) for a in texts for b in texts if a < b and texts[a].split() and bits(a, b) <= 2]
    assert near
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    nodes = rows.filter(F.trim("text").rlike(r"\S")).select(F.col("doc_id").alias("node"), F.lit(0).alias("size"), F.array().cast("array<long>").alias("keys"), F.col("doc_id").alias("row"))
    marked = nodes.join(simhash.fingerprints(rows).withColumnRenamed("doc_id", "node"), "node")
    found = {(r.node, r.component) for r in neardup.components(marked, rows).collect()}
    of = dict(found)
    assert all(of.get(a) == of.get(b) is not None for a, b in near if _similar(texts[a], texts[b]) >= 0.8)
    plain = _components(texts)
    assert found and all(plain[node] == plain[component] for node, component in found)
