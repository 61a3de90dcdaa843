import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from sentinel.llm import components as c
from sentinel.llm import minhash as m


def shingles(text):
    text = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < 5 else [tuple(words[i:i + 5]) for i in range(len(words) - 4)])


def brute(rows, percent=85):
    """Component per row by comparing all pairs; rows that share a doc_id are one document."""
    sets = [shingles(t) for _, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, (a, _)), (j, (b, _)) in combinations(enumerate(rows), 2):
        if a is None or b is None or not sets[i] or not sets[j]:
            continue
        both = len(sets[i] & sets[j])
        if 100 * both >= percent * len(sets[i] | sets[j]):
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    return [(i, len(s), i if i is None or not s else find(i)) for (i, _), s in zip(rows, sets)]


def result(df):
    out = m.near_duplicates(df).collect()
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in out)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=str)


def words(rng, n):
    return [f"w{rng.randint(0, 10**6)}" for _ in range(n)]


def edited(rng, text, n):
    text = list(text)
    for _ in range(n):
        text[rng.randrange(len(text))] = f"e{rng.randint(0, 10**9)}"
    return text


def test_signature_coordinates_are_circular_shifts():
    rng = np.random.default_rng(0)
    shingle = rng.integers(0, 2**63, 500, dtype=np.uint64)
    heads = np.array([0, 120, 121, 400])
    first, rows = m.permutations(12, 6)
    second = np.array([rows[p][0] for p in range(m.PLACES)])
    got = m.signatures(shingle, 12, heads, 6, step=64)
    for d, (lo, hi) in enumerate(zip(heads, [*heads[1:], 500])):
        place = first[(shingle[lo:hi] >> np.uint64(44)).astype(int)]
        for k in range(12):
            assert got[d, k] == second[(place + k) % m.PLACES].min()


def test_agreement_of_coordinates_estimates_similarity():
    rng = np.random.default_rng(1)
    common, rest = rng.integers(0, 2**63, 800, dtype=np.uint64), rng.integers(0, 2**63, 400, dtype=np.uint64)
    a, b = np.concatenate([common, rest[:200]]), np.concatenate([common, rest[200:]])
    s = m.signatures(np.concatenate([a, b]), 1000, np.array([0, len(a)]), 6)
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.06


def test_sets_against_brute_force(spark):
    texts = ["", None, " \n", "a", "A b", "a b c d", "a b c d e", "a b c d e a b c d e", "Ä É x y z", "a\tb\x0bc\x0cd\re f"]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    shingle, owner = m.shingle_sets(pa.array(texts, pa.string()))
    want = [shingles(t) for t in texts]
    assert np.bincount(owner, minlength=len(texts)).tolist() == [len(s) for s in want]
    names = {}
    for i, s in enumerate(want):
        for value in shingle[owner == i]:
            names.setdefault(int(value), set()).add(i)
    assert len(names) == len(set().union(*want))


def test_near_copies_chains_and_odd_rows(documents):
    rng = random.Random(3)
    base = words(rng, 200)
    rows = [(100 + i, " ".join(edited(rng, base, rng.randint(0, 4)))) for i in range(60)]
    rows += [(300 + i, " ".join(words(rng, rng.randint(1, 90)))) for i in range(60)]
    chain = words(rng, 100)
    for i in range(12):
        rows.append((500 + i, " ".join(chain)))
        chain = chain[1:] + words(rng, 1)
    rows += [(7, None), (8, ""), (9, " \t"), (10, "one two"), (11, "ONE two"), (12, "one two three"), (None, "one two"), (None, None),
             (13, " ".join(base)), (13, rows[70][1]), (14, rows[70][1].upper())]
    df = documents(rows, extra=("kept", "node", "n_shingles"))
    assert result(df) == sorted(brute(rows), key=str)


def test_blocks_of_a_crowded_bucket_lose_no_link(documents, monkeypatch):
    monkeypatch.setattr(m, "BLOCK_SHINGLES", 1500)
    rng = random.Random(5)
    base = words(rng, 120)
    rows = [(i, " ".join(edited(rng, base, rng.choice([1, 2, 2, 3])))) for i in range(120)]
    rows += [(i, rows[i % 50][1]) for i in range(200, 260)]
    df = documents(rows)
    sketches = m.sketch(df)
    classes = m.classes_of(sketches)
    out = m.place(sketches, classes, m.link_classes(df, classes, 85, block_shingles=1500))
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out.collect()), key=str) == sorted(brute(rows), key=str)


def test_common_passage_links_nothing(documents):
    rng = random.Random(6)
    passage = words(rng, 60)
    rows = [(i, " ".join(words(rng, 30) + passage + words(rng, 30))) for i in range(80)]
    assert result(documents(rows)) == sorted(brute(rows), key=str)


def test_empty(documents):
    assert m.near_duplicates(documents([])).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(100)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        parent[hi] = lo
    got = {r["node"]: r["component"] for r in c.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in touched}
