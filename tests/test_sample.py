"""Order statistics, sampling, scaling and neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentinel.functions.rand import exponential, uniform
from sentinel.operators import ranking, sample, scale, smote
from sentinel.operators.ranking import exact_quantiles, mark_smallest


def test_uniform_does_not_depend_on_partitioning(spark):
    a = {r["id"]: r["u"] for r in spark.range(0, 1000, 1, 2).withColumn("u", uniform(1, "s", "id")).collect()}
    b = {r["id"]: r["u"] for r in spark.range(0, 1000, 1, 7).withColumn("u", uniform(1, "s", "id")).collect()}
    assert a == b and 0.45 < sum(a.values()) / 1000 < 0.55
    assert all(0 <= u < 1 for u in a.values())
    mean = spark.range(5000).agg(F.avg(exponential(1, "e", "id"))).first()[0]
    assert 0.93 < mean < 1.07


@pytest.mark.parametrize("cells", [1, 4, 1 << 14])
def test_mark_smallest_matches_sorting(spark, monkeypatch, cells):
    """A group with most rows, tied draws, quotas of 0 and above the group size."""
    monkeypatch.setattr(ranking, "RANK_CELLS", cells)
    rng = np.random.default_rng(0)
    rows = [(("big" if i % 10 else f"s{i % 30}"), i, float(rng.integers(0, 50)) / 50) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, k long, u double")
    out = mark_smallest(df, ["g"], "u", "k", {
        "a": lambda n: F.floor(n * 0.3), "none": lambda n: F.lit(0), "all": lambda n: n})
    want = set()
    for g in {r[0] for r in rows}:
        part = sorted((u, k) for gg, k, u in rows if gg == g)
        want |= {k for _, k in part[:int(len(part) * 0.3)]}
    got = out.collect()
    assert len(got) == len(rows)
    assert {r["k"] for r in got if r["a"]} == want
    assert not any(r["none"] for r in got) and all(r["all"] for r in got)


@pytest.mark.parametrize("name", ["normal", "skewed", "ties", "constant", "single", "huge", "close"])
def test_quantiles_match_numpy(spark, name):
    rng = np.random.default_rng(3)
    x = {"normal": rng.normal(0, 1, 3001), "skewed": np.exp(rng.normal(0, 5, 2000)),
         "ties": rng.integers(-3, 3, 1000).astype(float), "constant": np.full(100, 2.5),
         "single": np.array([7.0]), "huge": np.array([-1e300, 0.0, 1e-12, 1e300, 5.0]),
         "close": 1.0 + rng.random(3000) * 1e-9}[name]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "value double").select(
        F.lit("f").alias("feature"), "value")
    probs = [0.0, 0.01, 0.5, 0.77, 0.99, 1.0]
    got = {r["prob"]: r for r in exact_quantiles(df, probs).collect()}
    for p in probs:
        assert got[p]["n"] == len(x)
        assert got[p]["quantile"] == pytest.approx(float(np.quantile(x, p)), rel=1e-12, abs=1e-300)


def test_subset_and_split(spark):
    df = spark.range(1000).withColumn(
        "label_multiclass", F.when(F.col("id") % 10 == 0, "DoS").otherwise("BENIGN"))
    part = sample.stratified_subset(df, 333, "id")
    assert {r[0]: r[1] for r in part.groupBy("label_multiclass").count().collect()} == {"DoS": 33, "BENIGN": 299}
    assert sample.stratified_subset(df, 5000, "id").count() == 1000
    split = sample.add_split(df, "id")
    counts = {(r[0], r[1]): r[2] for r in split.groupBy("label_multiclass", "split").count().collect()}
    assert counts == {("DoS", "train"): 60, ("DoS", "val"): 20, ("DoS", "test"): 20,
                      ("BENIGN", "train"): 540, ("BENIGN", "val"): 180, ("BENIGN", "test"): 180}
    again = sample.add_split(df.repartition(5), "id")
    assert split.select("id", "split").exceptAll(again.select("id", "split")).count() == 0
    other = sample.add_split(df, "id", seed=0)
    assert split.select("id", "split").exceptAll(other.select("id", "split")).count() > 0
    with pytest.raises(ValueError):
        sample.add_split(df, "id", test_size=0.6, val_size=0.5)


def test_resample_evens_out_classes(spark):
    df = spark.range(4000).withColumn("y", (F.col("id") % 8 == 0).cast("int"))
    counts = {r["y"]: r["count"] for r in sample.resample_balanced(df, "y", "id").groupBy("y").count().collect()}
    assert all(abs(n - 2000) < 200 for n in counts.values())


def test_resample_at_high_imbalance_and_without_labels(spark):
    df = spark.range(300_001).withColumn("y", F.when(F.col("id") == 0, 1).when(F.col("id") > 1, 0))
    counts = {r["y"]: r["count"] for r in sample.resample_balanced(df.where("id <> 1"), "y", "id").groupBy("y").count().collect()}
    assert abs(counts[0] - 150_000) < 2_000 and abs(counts[1] - 150_000) <= 1
    few = df.where("id < 10")
    counts = {r["y"]: r["count"] for r in sample.resample_balanced(few, "y", "id").groupBy("y").count().collect()}
    assert counts[None] in (3, 4) and counts[1] in (3, 4)


def test_rows_without_stratum_are_a_stratum(spark):
    df = spark.range(200).withColumn("label_multiclass", F.when(F.col("id") % 2 == 0, "A"))
    assert {r[0]: r[1] for r in sample.stratified_subset(df, 50, "id").groupBy("label_multiclass").count().collect()} == {"A": 25, None: 25}
    split = sample.add_split(df, "id").where("label_multiclass IS NULL").groupBy("split").count().collect()
    assert {r[0]: r[1] for r in split} == {"train": 60, "val": 20, "test": 20}


def test_running_totals_of_close_values(spark):
    rng = np.random.default_rng(4)
    x = np.unique(0.5 + rng.random(3000) * 1e-9)
    df = spark.createDataFrame([("k" if i % 3 else None, float(v), i % 7) for i, v in enumerate(x)], "k string, at double, n int")
    got = {(r["k"], r["at"]): r["n_before"] for r in ranking.running_before(df, ["k"], "at", ["n"]).collect()}
    for k in ("k", None):
        total = 0
        for i, v in enumerate(x):
            if ("k" if i % 3 else None) == k:
                assert got[k, float(v)] == total
                total += i % 7


def test_smote_refuses_rows_without_neighbours(spark):
    rows = [(i, [float(i)], c) for i, c in enumerate([0] * 20 + [1] * 6 + [2])]
    with pytest.raises(ValueError, match="2"):
        smote.smote(spark.createDataFrame(rows, "id long, x array<double>, y int"), "id", "x", "y")
    with pytest.raises(ValueError, match="no class"):
        smote.smote(spark.createDataFrame([*rows[:-1], (99, [1.0], None)], "id long, x array<double>, y int"), "id", "x", "y")


def test_scaler_and_bounds(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(3, 2, (400, 2))
    df = spark.createDataFrame([(float(a), float(b), 5.0) for a, b in x], "a double, b double, c double")
    out = scale.apply_scaler(df, scale.fit_scaler(df, ["a", "b", "c"]), ["a", "b", "c"]).toPandas()
    assert np.allclose(out[["a", "b"]].to_numpy(), (x - x.mean(0)) / x.std(0)) and (out["c"] == 0).all()
    got = {r["feature"]: r for r in scale.feature_bounds(df, ["a", "b"], 99, 0.0).collect()}
    assert got["a"]["lower"] == pytest.approx(np.percentile(x[:, 0], 1))
    assert got["b"]["upper"] == pytest.approx(np.percentile(x[:, 1], 99))
    wide = {r["feature"]: r for r in scale.feature_bounds(df, ["a"]).collect()}
    assert wide["a"]["lower"] < got["a"]["lower"] and wide["a"]["upper"] > got["a"]["upper"]


@pytest.mark.parametrize("pivots, chunk", [(1, 10_000), (6, 10_000), (6, 40), (40, 7)])
def test_neighbors_match_brute_force(spark, pivots, chunk):
    """Clustered points with one cluster far larger than the others."""
    rng = np.random.default_rng(5)
    centers = rng.normal(0, 20, (5, 3))
    which = np.where(rng.random(400) < 0.6, 0, rng.integers(0, 5, 400))
    x = centers[which] + rng.normal(0, 1, (400, 3))
    y = rng.integers(0, 2, 400)
    y[:3] = 2
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], int(y[i])) for i in range(400)],
                               "id long, x array<double>, y int")
    got = {}
    for r in smote.nearest_neighbors(df, "id", "x", "y", 4, n_pivots=pivots, chunk_rows=chunk).collect():
        got.setdefault(r["id"], {})[r["rank"]] = (r["neighbor"], r["distance"])
    for i in range(400):
        same = [j for j in range(400) if y[j] == y[i] and j != i]
        want = sorted((float(np.linalg.norm(x[i] - x[j])), j) for j in same)[:4]
        assert [got[i][k + 1][0] for k in range(len(want))] == [j for _, j in want]
        assert len(got[i]) == len(want)


def test_neighbors_of_equal_rows_and_work_that_grows_in_proportion(spark, monkeypatch):
    """A third of the rows is one point; with pivots bounded, twice the rows compare about twice as many pairs."""
    compared = []
    for n in (3000, 6000):
        rng = np.random.default_rng(n)
        x = rng.uniform(0, 100, (n, 2))
        x[: n // 3] = 50.0
        df = spark.createDataFrame([(i, [float(v) for v in x[i]], 0) for i in range(n)], "id long, x array<double>, y int")
        got = {}
        for r in smote.nearest_neighbors(df, "id", "x", "y", 3, n_pivots=8, chunk_rows=50).collect():
            got.setdefault(r["id"], {})[r["rank"]] = (r["neighbor"], r["distance"])
        assert len(got) == n and all(len(v) == 3 for v in got.values())
        for i in [0, n // 3 - 1, *rng.integers(n // 3, n, 40).tolist()]:
            d = np.linalg.norm(x - x[i], axis=1)
            d[i] = np.inf
            want = sorted(zip(d, range(n)))[:3]
            assert [round(got[i][r][1], 6) for r in (1, 2, 3)] == [round(float(v), 6) for v, _ in want]
        spread = df.where(f"id >= {n // 3}")
        leaves, stats = smote._leaves(spread.select("id", F.col("y").alias("cls"), "x", F.lit(0).alias("cell"), F.lit(0.0).alias("away")), np.array([[50.0, 50.0]]), 50, 42,
                                      "id long, cls int, x array<double>")
        compared.append(stats.agg(F.sum(F.col("n") * F.col("n"))).first()[0])
    assert compared[1] < 3 * compared[0]


def test_smote_fills_all_classes(spark):
    rng = np.random.default_rng(1)
    y = [0] * 50 + [1] * 20 + [2] * 7
    df = spark.createDataFrame([(i, [float(v) for v in rng.normal(c, 1, 3)], c) for i, c in enumerate(y)],
                               "id long, x array<double>, y int")
    out = smote.smote(df, "id", "x", "y").collect()
    assert {c: sum(r["y"] == c for r in out) for c in (0, 1, 2)} == {0: 0, 1: 30, 2: 43}
    points = {r["id"]: np.array(r["x"]) for r in df.collect()}
    for r in out:
        a, b, p = points[r["origin"]], points[r["neighbor"]], np.array(r["x"])
        assert y[r["origin"]] == y[r["neighbor"]] == r["y"]
        assert np.linalg.norm(p - a) + np.linalg.norm(b - p) == pytest.approx(np.linalg.norm(b - a))
