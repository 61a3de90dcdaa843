import numpy as np
import pytest
from pyspark.sql import functions as F

from sentinel.operators import boosting as b


def plain_booster(x, y, k, rounds, depth, rate=0.3, l2=1.0, least=1.0, objective="softmax", bins=64):
    """Node by node on exact sorted values of the same candidate cuts, with float sums."""
    cuts = [np.unique(np.quantile(x[:, f], [i / bins for i in range(1, bins)])) for f in range(x.shape[1])]
    groups = 1 if objective == "logistic" else k
    margins = np.zeros((len(x), groups))
    all_splits = []
    for _ in range(rounds):
        if objective == "softmax":
            e = np.exp(margins - margins.max(1, keepdims=True))
            p = e / e.sum(1, keepdims=True)
        else:
            p = 1 / (1 + np.exp(-margins))
        hit = (y == 1)[:, None] if objective == "logistic" else y[:, None] == np.arange(k)[None, :]
        g, h = p - hit, np.maximum((2 if objective == "softmax" else 1) * p * (1 - p), 1e-6)
        step = np.zeros_like(margins)
        for c in range(groups):
            stack, splits = [(np.arange(len(x)), 0)], []
            while stack:
                rows, level = stack.pop()
                gg, hh = g[rows, c].sum(), h[rows, c].sum()
                best = (1e-6, None)
                if level < depth:
                    for f in range(x.shape[1]):
                        for t in cuts[f]:
                            left = x[rows, f] <= t
                            gl, hl = g[rows, c][left].sum(), h[rows, c][left].sum()
                            if hl < least or hh - hl < least:
                                continue
                            gain = gl**2 / (hl + l2) + (gg - gl) ** 2 / (hh - hl + l2) - gg**2 / (hh + l2)
                            if gain > best[0] + 1e-9:
                                best = (gain, (f, t, left))
                if best[1] is None:
                    step[rows, c] = -rate * gg / (hh + l2)
                else:
                    f, t, left = best[1]
                    splits.append((level, f, round(t, 9)))
                    stack += [(rows[~left], level + 1), (rows[left], level + 1)]
            all_splits.append(sorted(splits))
        margins += step
    if objective == "logistic":
        p = 1 / (1 + np.exp(-margins))
        return np.hstack([1 - p, p]), all_splits
    if objective == "one_vs_rest":
        p = 1 / (1 + np.exp(-margins))
        return p / p.sum(1, keepdims=True), all_splits
    e = np.exp(margins - margins.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True), all_splits


def splits_of(model):
    out = []
    for group in model.trees:
        for t in group:
            level = {0: 0}
            for i, f in enumerate(t.feature):
                if f >= 0:
                    level[t.left[i]] = level[t.right[i]] = level[i] + 1
            out.append(sorted((level[i], f, round(t.threshold[i], 9)) for i, f in enumerate(t.feature) if f >= 0))
    return out


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 4)).round(3)
    x[:, 2] = np.round(x[:, 2])
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0.3).astype(int) + (x[:, 3] > 1).astype(int)
    rows = [(i, [float(v) for v in r], int(c), int(c > 0)) for i, (r, c) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, "row_id long, features array<double>, y int, b int").repartition(3)


@pytest.mark.parametrize("objective,label", [("softmax", "y"), ("one_vs_rest", "y"), ("logistic", "b")])
def test_equals_a_plain_booster(data, objective, label):
    x, y, df = data
    target = y if label == "y" else (y > 0).astype(int)
    model = b.train(df, "features", label, 3 if label == "y" else 2, rounds=4, depth=4, objective=objective)
    want, splits = plain_booster(x, target, 3, 4, 4, objective=objective)
    assert splits_of(model) == splits
    got = {r["row_id"]: r for r in b.predict(df, model).collect()}
    assert np.abs(np.array([got[i]["probs"] for i in range(len(x))]) - want).max() < 1e-5
    assert all(abs(sum(r["probs"]) - 1) < 1e-12 and r["y_pred"] == int(np.argmax(r["probs"])) for r in got.values())


def test_independent_of_partitions_and_passes(data, monkeypatch):
    _, _, df = data
    first = b.train(df, "features", "y", 3, rounds=3, depth=5)
    monkeypatch.setattr(b, "CELLS_PER_TASK", 100)
    monkeypatch.setattr(b, "LOCAL_ROWS", 0)
    monkeypatch.setattr(b, "HELD_BYTES", 4 * 4 * 64 * 24)
    monkeypatch.setattr(b, "LINEAGE_ROUNDS", 2)
    second = b.train(df.repartition(7), "features", "y", 3, rounds=3, depth=5)
    assert [[vars(t) for t in g] for g in first.trees] != [] and second.passes > first.passes
    monkeypatch.setattr(b, "LOCAL_ROWS", 60)
    third = b.train(df.repartition(2), "features", "y", 3, rounds=3, depth=5)
    order = lambda m: [sorted(zip(t.feature, t.bin, t.threshold, t.value, t.gain)) for g in m.trees for t in g]
    assert order(first) == order(second) == order(third)


def test_default_size_separates_a_hard_problem(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(int)
    df = spark.createDataFrame([([float(v) for v in r], int(c), i % 3 == 0) for i, (r, c) in enumerate(zip(x, y))], "features array<double>, y int, held boolean")
    model = b.train(df.where("NOT held"), "features", "y", 2, rounds=30)
    assert b.predict(df.where("held"), model).where("y = y_pred").count() > 950
    assert b.importances(model, 6)[:2].sum() > 0.5


def test_missing_values_go_left(spark):
    rows = [([None if i % 2 else float("nan")] if i < 50 else [float(i)], int(i >= 75)) for i in range(100)]
    df = spark.createDataFrame(rows, "features array<double>, y int")
    out = b.predict(df, b.train(df, "features", "y", 2, rounds=3, depth=2)).collect()
    assert all(r["y_pred"] == r["y"] for r in out)


def test_constant_features_and_bad_calls(spark):
    df = spark.createDataFrame([([1.0], 0), ([1.0], 1), ([1.0], 1)], "features array<double>, y int")
    model = b.train(df, "features", "y", 2, rounds=40)
    assert b.predict(df, model).first()["probs"][1] == pytest.approx(0.6, abs=0.07)
    with pytest.raises(ValueError):
        b.train(df.limit(0), "features", "y", 2)
    with pytest.raises(ValueError):
        b.train(df, "features", "y", 2, objective="hinge")
    with pytest.raises(ValueError):
        b.train(df, "features", "y", 2, bins=1000)


def test_round_trip(spark, data, tmp_path):
    _, _, df = data
    model = b.train(df, "features", "y", 3, rounds=2, depth=3)
    b.save(spark, model, f"{tmp_path}/m")
    again = b.load(spark, f"{tmp_path}/m")
    assert [[vars(t) for t in g] for g in again.trees] == [[vars(t) for t in g] for g in model.trees]
    assert b.predict(df, again).select("row_id", "probs").exceptAll(b.predict(df, model).select("row_id", "probs")).count() == 0
    with pytest.raises(FileNotFoundError):
        b.load(spark, f"{tmp_path}/none")
    assert b.nodes(spark, model).where(F.col("feature") < 0).count() > 0


def test_histograms_stay_on_the_cluster(data, monkeypatch):
    """However small the driver's share is, the trees are the same; above it no histogram is sent to the driver."""
    _, _, df = data
    monkeypatch.setattr(b, "LOCAL_ROWS", 20)
    order = lambda m: [sorted(zip(t.feature, t.bin, t.threshold, t.value, t.gain)) for g in m.trees for t in g]
    monkeypatch.setattr(b, "DRIVER_BYTES", 1 << 30)
    at_driver = order(b.train(df, "features", "y", 3, rounds=2, depth=5))
    monkeypatch.setattr(b, "DRIVER_BYTES", 2 * 4 * 64 * 24)
    mixed = order(b.train(df, "features", "y", 3, rounds=2, depth=5))
    monkeypatch.setattr(b, "DRIVER_BYTES", 0)
    monkeypatch.setattr(b._Grower, "_sums", lambda *_: pytest.fail("a histogram came to the driver"))
    assert order(b.train(df, "features", "y", 3, rounds=2, depth=5)) == at_driver == mixed


def test_nodes_with_few_features_leave_the_levels_earlier(spark):
    """One pass a round: a task may grow a node from as many cells as rows of many features would have."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(6000, 4)), 2)
    df = spark.createDataFrame([([float(v) for v in r], int(r[0] * r[1] > 0.1)) for r in x], "features array<double>, y int")
    assert b.train(df, "features", "y", 2, rounds=2, depth=4).passes == 2


def test_places_follow_the_splits():
    rng = np.random.default_rng(4)
    tree, open_nodes = b.Tree.leaf(), [0]
    for _ in range(9):
        node = open_nodes.pop(0)
        open_nodes += tree.split(node, int(rng.integers(3)), 0, float(rng.normal()), 1.0)
    values = rng.normal(size=(3, b.PLACED_ROWS + 50))
    values[1, ::10] = np.nan

    def leaf(column):
        node = 0
        while tree.feature[node] >= 0:
            node = tree.right[node] if column[tree.feature[node]] > tree.threshold[node] else tree.left[node]
        return node

    assert tree.places(values, tree.threshold).tolist() == [leaf(c) for c in values.T]
    assert b.Tree.leaf().places(values, [0.0]).tolist() == [0] * values.shape[1]
