import numpy as np
import pytest
from pyspark.sql import functions as F

from sentinel.llm import multi_index as m


def brute(ids, x, queries, k):
    norms = np.linalg.norm(x, axis=1)
    out = {}
    for i in queries:
        s = x @ x[i] / (norms * norms[i])
        order = [j for j in np.lexsort((ids, -np.round(s, 12))) if j != i]
        out[ids[i]] = [(ids[j], s[j]) for j in order[:k]]
    return out


def as_dict(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x)], "vec_id long, embedding array<float>")


def test_visits_follow_summed_distance():
    rng = np.random.default_rng(0)
    a, b, counts = rng.random(6), rng.random(5), rng.integers(0, 4, 30)
    order = m.visits(a, b, counts, 10**9)
    total = {i * 5 + j: a[i] + b[j] for i in range(6) for j in range(5)}
    assert order == sorted((c for c in total if counts[c]), key=total.get)
    part = m.visits(a, b, counts, 7)
    assert part == order[:len(part)] and counts[part].sum() >= 7 > counts[part[:-1]].sum()


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_table(spark, sf):
    table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = table.toPandas()
    ids, x = rows["vec_id"].to_numpy(), np.stack(rows["embedding"]).astype(float)
    want = brute(ids, x, np.flatnonzero(ids % 50 == 0), 5)
    got = as_dict(m.search(table, F.col("vec_id") % 50 == 0).collect())
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    where = {i: p for p, i in enumerate(ids)}
    for q, found in got.items():
        for i, s in found:
            u, v = x[where[q]], x[where[i]]
            assert abs(s - u @ v / np.linalg.norm(u) / np.linalg.norm(v)) < 1e-12


def test_copies_ties_and_hot_vectors(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([np.tile([1.0, 2.0, 3.0, 4.0], (150, 1)), rng.normal(size=(60, 4))])
    ids = np.arange(len(x)) * 10
    got = as_dict(m.search(frame(spark, ids, x), F.col("vec_id") % 50 == 0, per_cell=10, recall=1.0).collect())
    for q, found in got.items():
        if q < 1500:
            assert [i for i, _ in found] == [i for i in range(0, 70, 10) if i != q][:5]


def test_unusable_vectors_and_few_rows(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]),
            (6, []), (None, [1.0, 1.0]), (100, [1e200, 1e200]), (0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x")).withColumn("h", F.lit(1))
    got = as_dict(m.search(df, F.col("vec_id") % 50 == 0).collect())
    assert {q: [i for i, _ in v] for q, v in got.items()} == {0: [100, 50], 50: [100, 0], 100: [0, 50]}
    assert abs(got[0][0][1] - 0.5**0.5) < 1e-12
    assert m.search(df.limit(0), F.lit(True)).count() == 0


def test_blocks_cut_hot_cells(spark, monkeypatch):
    monkeypatch.setattr(m, "CHUNK", 16)
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(1, 8)) + 0.01 * rng.normal(size=(150, 8)), rng.normal(size=(100, 8))])
    ids = np.arange(len(x))
    want = brute(ids, x.astype(np.float32).astype(float), np.flatnonzero(ids % 5 == 0), 5)
    got = as_dict(m.search(frame(spark, ids, x), F.col("vec_id") % 5 == 0, per_cell=20, recall=1.0).collect())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.97 * 5 * len(want)
