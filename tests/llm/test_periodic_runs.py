import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sentinel.llm import periodic_runs as p


def brute(words):
    """Every maximal stretch of period q, shortest period of its own only."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and not any(all(words[k] == words[k + r] for k in range(i, j + q - r)) for r in range(1, q)):
                out.append((i, j + q - i, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=120))
def test_random_sequences(values):
    assert p.find_runs(np.array(values, np.int64)) == brute(values)


@pytest.mark.parametrize("seed", range(40))
def test_planted_runs(seed):
    rng = random.Random(seed)
    values = []
    while len(values) < 700:
        root = [rng.randrange(rng.choice((2, 4, 50))) for _ in range(rng.choice((1, 2, 3, 5, 8, 13, 31, 64, 100)))]
        values += (root * 12)[:rng.randrange(1, 6 * len(root) + 2)] + [rng.randrange(10**6) for _ in range(rng.randrange(4))]
    assert p.find_runs(np.array(values, np.int64)) == brute(values)


def test_large_numbers_and_long_runs():
    rng = np.random.default_rng(1)
    root = rng.integers(0, 2**40, 5000)
    values = np.concatenate([rng.integers(0, 2**40, 777), np.tile(root, 4), root[:10], rng.integers(0, 2**40, 55)])
    assert p.find_runs(values) == [(777, 20_010, 5000)]
    assert p.find_runs(np.zeros(100_000, np.int64)) == [(0, 100_000, 1)]


@pytest.mark.parametrize("n", [2, 4, 64, 1024])
def test_transform(n):
    rng = np.random.default_rng(n)
    x = rng.integers(0, p.PRIME, (3, n)).astype(np.uint64)
    root = pow(p.GENERATOR, (p.PRIME - 1) // n, p.PRIME)
    got = p.ntt(x)
    for k in (0, 1, n - 1):
        assert [int(v) for v in got[:, k]] == [sum(int(v) * pow(root, j * k, p.PRIME) for j, v in enumerate(row)) % p.PRIME for row in x]
    assert (p.ntt(got, inverse=True) == x).all()


def expected(doc_id, text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if n and h is not None and h % 10 == 0:
        g = h // 10
        a = g % n
        period = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % period] for i, w in enumerate(words)]
    found = brute(words)
    drop = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    return (len(found), *best, None if best[0] is None else 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(),
            hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in drop).encode()).hexdigest())


def test_report_against_brute_force(documents, spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = [(i, t if t is None or len(t) < 6000 else t[:6000]) for i, t in rows]
    rows += [(None, None), (None, "a b " * 30), (1001, None), (1002, ""), (1003, " \n\t"), (1004, "x y " * 9), (1004, "x y " * 9), (1005, "a a a a a"), (1006, "a\x0ba\x0ca\ra a\ta")]
    out = p.report(documents(rows, extra=("runs", "start", "n_words")), p.repeat_tails).collect()
    assert sorted(map(str, (tuple(r) for r in out))) == sorted(str((i, *expected(i, t))) for i, t in rows)
    assert sum(r["n_runs"] > 0 for r in out) > 10


def test_runs_and_collapsed_text(documents):
    out = p.runs(documents([(1, "so it goes " + "on and " * 5 + "over"), (2, "")])).collect()
    assert [tuple(r) for r in out[0]["runs"]] == [(3, 10, 2)] and out[0]["collapsed"] == "so it goes on and over"
    assert out[1]["runs"] == [] and out[1]["collapsed"] == "" and out[1]["n_words"] == 0


def test_very_long_text_and_empty_table(documents):
    text = "w " * 300_000 + "end"
    out = p.report(documents([(None, text)]), p.repeat_tails).first()
    assert (out["n_runs"], out["start"], out["length"], out["period"]) == (1, 0, 300_000, 1)
    assert p.report(documents([]), p.repeat_tails).count() == 0
