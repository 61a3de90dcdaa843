"""Forests on counted cells, against brute force and under copies and other partitions."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sentinel.operators import baselines, forest


def table(spark, x, y):
    rows = [(int(c), [None if v is None else float(v) for v in row]) for row, c in zip(x, y)]
    return spark.createDataFrame(rows, "y int, features array<double>")


@pytest.fixture(scope="module")
def mixed(spark):
    """400 rows, a feature of 40 values, one of 5, one of noise; the third class is rare."""
    rng = np.random.default_rng(7)
    x = np.stack([rng.integers(0, 40, 400), rng.integers(0, 5, 400), rng.normal(0, 1, 400)], axis=1)
    y = np.where(x[:, 0] > 36, 2, (x[:, 0] + 4 * x[:, 1] + rng.normal(0, 4, 400) > 28).astype(int))
    return table(spark, x, y).cache()


def same(a, b):
    return (a.n_classes == b.n_classes and [(t.feature, t.bin, t.threshold, t.gain) for t in a.trees] == [(t.feature, t.bin, t.threshold, t.gain) for t in b.trees]
            and all(np.array_equal(p, q) for p, q in zip(a.counts, b.counts)))


def cells_of(monkeypatch):
    seen, inner = [], forest._blocks
    monkeypatch.setattr(forest, "_blocks", lambda cells, n, *rest: seen.append(n) or inner(cells, n, *rest))
    return seen


def test_a_forest_does_not_depend_on_partitions(mixed):
    one, other = (baselines.train_forest(mixed.repartition(n), "features", "y", n_trees=5, depth=4) for n in (2, 7))
    a, b = (baselines.feature_importances(m, mixed, list("abc")).collect() for m in (one, other))
    assert a == b and same(one, other)
    assert not same(one, baselines.train_forest(mixed, "features", "y", n_trees=5, depth=4, seed=1))


def test_copies_add_no_work(spark, mixed, monkeypatch):
    seen = cells_of(monkeypatch)
    baselines.train_forest(mixed, "features", "y", n_trees=2, depth=2)
    baselines.train_forest(mixed.crossJoin(spark.range(50)).drop("id"), "features", "y", n_trees=2, depth=2)
    assert len(seen) == 2 and max(seen) <= 400


def test_distinct_rows_of_the_same_bins_are_one_cell(spark, monkeypatch):
    seen = cells_of(monkeypatch)
    for n in (2000, 20_000):
        rows = spark.range(n).select((F.col("id") % 2).cast("int").alias("y"), F.array(F.col("id").cast("double"), (F.col("id") * 7919 % n).cast("double")).alias("features"))
        baselines.train_forest(rows, "features", "y", n_trees=2, depth=2)
    assert seen[1] <= 2 * 32 * 32 and seen[0] <= 2000


def test_a_cell_is_drawn_as_its_rows_would_be():
    """A cell of n rows gets Poisson(n) per tree, and the same in whichever partition it lies."""
    batch = pa.RecordBatch.from_pydict({"bins": [b"\x00", b"\x01", b"\x02"], "y": pa.array([0, 1, 0], pa.int32()), "n": [1, 400, 3], "key": [5, -6, 7]})
    draws = forest._unpacked(next(forest._drawn([batch], 1, 20_000, 42)).to_pylist()[0])[2]
    assert draws.shape == (20_000, 3)
    for k, n in enumerate((1, 400, 3)):
        assert draws[:, k].mean() == pytest.approx(n, rel=0.05) and draws[:, k].astype(float).var() == pytest.approx(n, rel=0.1)
    assert np.mean(draws[:, 0] == 0) == pytest.approx(np.exp(-1), abs=0.02)
    alone = forest._unpacked(next(forest._drawn([batch.slice(1, 1)], 1, 20_000, 42)).to_pylist()[0])[2]
    assert np.array_equal(alone[:, 0], draws[:, 1])
    assert abs(np.corrcoef(draws[:, 0].astype(float), draws[:, 2].astype(float))[0, 1]) < 0.03


def test_splits_against_brute_force(mixed, monkeypatch):
    """Every node holds the drawn rows that reach it, and splits at the best cut of its drawn features."""
    kept, inner = [], forest._grown
    monkeypatch.setattr(forest, "_grown", lambda state, cuts, shape, weight, *rest: kept.append((state.collect(), shape, weight)) or inner(state, cuts, shape, weight, *rest))
    model = forest.train(mixed, "features", "y", n_trees=3, depth=4)
    blocks, shape, weight = kept[0]
    at, y, draws = (np.concatenate([b[i] for b in blocks], axis=-1) for i in range(3))
    sizes = np.bincount([r["y"] for r in mixed.collect()])
    assert weight == pytest.approx(400 / (3 * sizes)) and shape.drawn == 2

    def impurity(counts):
        return counts.sum() - (counts ** 2).sum() / counts.sum() if counts.sum() else 0.0

    splits = 0
    for number, (tree, counts) in enumerate(zip(model.trees, model.counts)):
        level_nodes = [(0, np.ones(len(y), bool))]
        for level in range(5):
            drawn = [n for n, rows in level_nodes if level == 0 or len(set(y[rows & (draws[number] > 0)])) > 1]
            chosen = shape.features_of(number, level, len(drawn)) if drawn else []
            following = []
            for node, rows in level_nodes:
                count = lambda some: np.bincount(y[some], draws[number][some], 3) * weight  # noqa: E731, B023
                assert counts[node] == pytest.approx(count(rows))
                best = 0.0
                if node in drawn and level < 4:
                    for f in chosen[drawn.index(node)]:
                        for cut in range(31):
                            best = max(best, impurity(count(rows)) - impurity(count(rows & (at[f] <= cut))) - impurity(count(rows & (at[f] > cut))))
                assert tree.gain[node] == pytest.approx(best, abs=1e-8)
                if tree.feature[node] >= 0:
                    splits += 1
                    right = at[tree.feature[node]] > tree.bin[node]
                    following += [(tree.left[node], rows & ~right), (tree.right[node], rows & right)]
            level_nodes = following
    assert splits > 20


def test_passes_of_few_trees_give_the_same_forest(mixed, monkeypatch):
    whole = forest.train(mixed, "features", "y", n_trees=5, depth=3)
    monkeypatch.setattr(forest, "HELD_CELLS", 500)
    assert same(whole, forest.train(mixed, "features", "y", n_trees=5, depth=3))


def test_probabilities_are_shares_of_leaves(mixed):
    model = forest.train(mixed, "features", "y", n_trees=4, depth=3)
    for r in baselines.predict(model, mixed, "features").limit(40).collect():
        votes = np.zeros(3)
        for tree, counts in zip(model.trees, model.counts):
            node = 0
            while tree.feature[node] >= 0:
                node = (tree.right if r["features"][tree.feature[node]] > tree.threshold[node] else tree.left)[node]
            votes += counts[node] / counts[node].sum()
        assert r["probs"] == pytest.approx(votes / 4) and r["y_pred"] == int(np.argmax(r["probs"]))


def test_cuts(spark):
    x = [[v, v % 3, None if v % 2 else 1.0, [-np.inf, 2.0, np.inf][v % 3], 1.0] for v in range(100)]
    rows = table(spark, x, [0] * 90 + [1] * 10).select(F.col("features").alias("x"), "y")
    many, few, half, ends, one = forest.feature_cuts(rows, 5, 8)
    assert few.tolist() == [0.5, 1.5] and half.tolist() == [] and one.tolist() == [] and ends.tolist() == [-np.inf, 2.0]
    assert len(many) <= 7 and (many >= 89).sum() >= 3  # the rare class has half the weight


def test_odd_rows(spark, tmp_path):
    hole = table(spark, [[None, 1.0], [np.nan, 2.0], [5.0, 1.0], [6.0, 2.0]] * 20, [0, 0, 0, 1] * 20)
    model = baselines.train_forest(hole, "features", "y", n_trees=8, depth=3)
    assert baselines.predict(model, hole, "features").where("y = y_pred").count() == 80
    one = baselines.train_forest(table(spark, [[1.0]], [0]), "features", "y", n_trees=3, depth=2)
    assert baselines.feature_importances(one, hole, ["a"]).first()["importance"] == 0
    baselines.save_model(model, f"{tmp_path}/m")
    assert same(baselines.load_model(spark, f"{tmp_path}/m"), model)
    with pytest.raises(ValueError):
        baselines.train_forest(hole.where("false"), "features", "y")
    for label in (None, -1, 100):
        with pytest.raises(ValueError):
            baselines.train_forest(hole.withColumn("y", F.lit(label).cast("int")), "features", "y")
