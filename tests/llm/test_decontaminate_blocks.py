from __future__ import annotations

import pytest
from aurigraph.llm import decontaminate


def _words(name: str, n: int) -> str:
    return " ".join(f"{name}{i}" for i in range(n))


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_many_blocks_cut_as_one(spark, monkeypatch, broadcast_rows):
    """Coverage counts the hits of all blocks, and passages that overlap over blocks are cut whole."""
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast_rows)
    long_a, long_b, chain = _words("a", 30), _words("b", 30), _words("c", 25)
    items = spark.createDataFrame([(1, long_a), (2, long_b), (3, " ".join(chain.split()[:15])), (4, " ".join(chain.split()[8:])), (5, "short one")], "item_id long, text string")
    docs = [
        (1, f"{_words('x', 20)} {long_a} {long_b} {_words('y', 20)}"),  # 60 of 100 words over two items
        (2, f"{_words('x', 40)} {chain} {_words('y', 40)}"),
        (3, f"{_words('x', 30)}, {long_a}. {_words('y', 30)}"),
        (4, f"short {long_a} one {_words('x', 60)} short one"),  # cutting must not make words meet
        (5, None),
        (5, ""),
    ]
    rows = spark.createDataFrame([(i, t, None if t is None else len(t)) for i, t in docs], "doc_id long, text string, n_chars int")
    one = sorted(map(tuple, decontaminate.decontaminate(rows, items).collect()), key=repr)
    many = decontaminate.decontaminate(rows, items, block_bytes=40)
    assert many.schema == rows.schema
    assert sorted(map(tuple, many.collect()), key=repr) == one
    kept = {r[0]: r[1] for r in one}
    assert 1 not in kept and kept[2] == f"{_words('x', 40)} {_words('y', 40)}"
