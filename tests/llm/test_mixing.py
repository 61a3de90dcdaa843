import random
from collections import defaultdict

import numpy as np
import pytest

from sentinel.llm import mixing as m


def water_fill(sizes, weights, share, most):
    """Targets by resharing the excess until none is above its limit."""
    total, full = share * sum(sizes.values()), {}
    while True:
        rest = {s: weights[s] for s in sizes if s not in full}
        left = total - sum(full.values())
        out = {s: left * w / sum(rest.values()) for s, w in rest.items()} if rest else {}
        over = [s for s, t in out.items() if t > most * sizes[s]]
        if not over:
            return {**full, **out}
        full |= {s: most * sizes[s] for s in over}


def rows_for(rng, n):
    return [(i, " ".join(["w"] * rng.choice([0, 1, 3, 40, 200])), "en", rng.choice(["a", "a", "a", "a", "b", "c", "dd", None])) for i in range(n)]


def test_block_keeps_words_and_decides_all_but_one():
    rng = np.random.default_rng(1)
    for _ in range(20):
        n = rng.integers(1, 60)
        size, p = rng.integers(1, 500, n), rng.random(n)
        out = m.pivot_block(rng.integers(0, 2**63, n).astype(np.uint64), size, p, 0)
        assert ((out > 0) & (out < 1)).sum() <= 1 and abs((out * size).sum() - (p * size).sum()) < 1e-6
        assert ((out >= 0) & (out <= 1)).all()


def test_expectations_are_kept():
    size, p = np.array([5, 70, 30, 200, 1, 90]), np.array([0.2, 0.5, 0.9, 0.35, 0.6, 0.1])
    rng, total = np.random.default_rng(2), np.zeros(6)
    for _ in range(4000):
        total += m.pivot_block(rng.integers(0, 2**63, 6).astype(np.uint64), size, p, 0)
    assert np.abs(total / 4000 - p).max() < 0.04


@pytest.mark.parametrize("block_rows, fan_in", [(4096, 64), (16, 4)])
def test_mix(documents, monkeypatch, block_rows, fan_in):
    monkeypatch.setattr(m.rounded, "__defaults__", (block_rows, fan_in))
    rows = rows_for(random.Random(3), 700)
    rows += [rows[5]] * 9 + [(None, "x y z", "en", "a"), (900, None, "en", None)]
    df = documents(rows, extra=("size", "taken", "copy", "weight"))
    out = m.mix(df).collect()
    size_of = lambda t: len((t or "").split())
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += size_of(t)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = water_fill(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5, 2)
    source = {i: s for i, _, _, s in rows}
    assert sorted(((r["doc_id"], r["size"]) for r in out), key=str) == sorted(((i, size_of(t)) for i, t, _, _ in rows), key=str)
    taken = defaultdict(int)
    for r in out:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(goal[s])
        assert r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - goal[s]) <= 200 for s in sizes)
    again = m.mix(df.repartition(7)).collect()
    key = lambda r: str((r["doc_id"], r["size"], r["taken"], r["key"]))
    assert sorted(out, key=key) == sorted(again, key=key)
    mixed = m.mixed(df)
    assert mixed.columns == df.columns
    copies, want = defaultdict(int), defaultdict(int)
    for r in mixed.collect():
        copies[r["doc_id"]] += 1
    for r in out:
        want[r["doc_id"]] += r["copies"]
    assert copies == {k: v for k, v in want.items() if v}


def test_empty_and_wordless(documents):
    assert m.mix(documents([])).count() == 0 and m.mixed(documents([])).count() == 0
    out = m.mix(documents([(1, None), (2, " ")])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in out] == [(0, 0.0, 0)] * 2


def test_all_words_in_one_source(documents):
    out = m.mix(documents([(i, "a b c", "en", "only") for i in range(11)])).collect()
    assert {r["target"] for r in out} == {49.5} and abs(sum(r["taken"] for r in out) - 49.5) <= 3
