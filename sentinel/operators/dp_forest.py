"""Differentially private forest: random splits, noisy leaf votes, pure epsilon.

Splits are drawn from a seed and the feature bounds and never look at rows. Each row votes in one
tree only, so the trees compose in parallel and all spend the full budget. A leaf's label is chosen
by permute-and-flip, in its equivalent form argmax(count + exponential noise). Empty leaves and
classes take part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentinel.functions.cols import argmax, array_sql, double
from sentinel.functions.rand import exponential, secret_seed, uniform
from sentinel.schema import EPSILON_GRID


def _draw(seed: int | str, *parts: object) -> float:
    text = ":".join(str(p) for p in (seed, *parts))
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / float(1 << 52)


@dataclass(frozen=True)
class Forest:
    """Split feature and position within its bounds for every inner node, heap order."""

    depth: int
    features: tuple[tuple[int, ...], ...]
    positions: tuple[tuple[float, ...], ...]

    @property
    def n_trees(self) -> int:
        return len(self.features)

    @property
    def n_leaves(self) -> int:
        return 1 << self.depth


def random_forest_structure(n_features: int, n_trees: int = 10, depth: int = 5,
                            seed: int | str = 42) -> Forest:
    inner = (1 << depth) - 1
    return Forest(
        depth,
        tuple(tuple(int(_draw(seed, "feature", t, i) * n_features) for i in range(inner))
              for t in range(n_trees)),
        tuple(tuple(round(_draw(seed, "position", t, i), 6) for i in range(inner))
              for t in range(n_trees)),
    )


def _thresholds(forest: Forest, lower: Sequence[float], upper: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """Split feature and threshold of every inner node, one row per tree."""
    features = np.array(forest.features, dtype=np.int64).reshape(forest.n_trees, -1)
    low, high = np.array(lower, dtype=float), np.array(upper, dtype=float)
    return features, low[features] + np.array(forest.positions).reshape(features.shape) * (high[features] - low[features])


def _descend(x: np.ndarray, tree: np.ndarray | int, features: np.ndarray, thresholds: np.ndarray, depth: int) -> np.ndarray:
    """Leaf number of each row in one tree (or in a tree of its own). Values go right if above the threshold; missing ones go left."""
    node, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
    for _ in range(depth):
        right = x[rows, features[tree, node]] > thresholds[tree, node]
        node = 2 * node + 1 + right
    return node - ((1 << depth) - 1)


def _inputs(inputs: Sequence[str]) -> Column:
    """The inputs as one array of doubles; NaN counts as larger than any number."""
    return F.expr("array(" + ", ".join(f"CASE WHEN isnan({i}) THEN double('Infinity') ELSE CAST({i} AS DOUBLE) END" for i in inputs) + ")")


def _matrix(x: pd.Series) -> np.ndarray:
    return np.stack(x.to_numpy()).astype(np.float64)


def route(df: DataFrame, forest: Forest, inputs: Sequence[str], lower: Sequence[float],
          upper: Sequence[float], name: str = "leaves") -> DataFrame:
    """Add the array of leaf numbers, one per tree. ``inputs`` are column names or SQL expressions."""
    features, thresholds, depth, trees = *_thresholds(forest, lower, upper), forest.depth, forest.n_trees

    @F.pandas_udf("array<int>")
    def leaves(x: pd.Series) -> pd.Series:
        m = _matrix(x)
        return pd.Series(list(np.column_stack([_descend(m, t, features, thresholds, depth) for t in range(trees)]).astype(np.int32)))

    return df.withColumn(name, leaves(_inputs(inputs)))


def leaf_counts(train: DataFrame, forest: Forest, key: str, label: str, n_classes: int,
                inputs: Sequence[str], lower: Sequence[float], upper: Sequence[float],
                seed: int | str = 42) -> DataFrame:
    """(tree, leaf, class, n) for all leaves and classes.

    Each row descends and counts in one tree only, chosen by its key.
    """
    features, thresholds, depth = *_thresholds(forest, lower, upper), forest.depth

    @F.pandas_udf("int")
    def leaf(x: pd.Series, tree: pd.Series) -> pd.Series:
        return pd.Series(_descend(_matrix(x), tree.to_numpy(), features, thresholds, depth).astype(np.int32))

    seen = (
        train.withColumn("tree", F.floor(uniform(seed, "tree", key) * forest.n_trees).cast("int"))
        .select("tree", leaf(_inputs(inputs), F.col("tree")).alias("leaf"), F.col(label).cast("int").alias("class"))
        .groupBy("tree", "leaf", "class").agg(F.count(F.lit(1)).alias("n"))
    )
    cells = forest.n_trees * forest.n_leaves * n_classes
    grid = train.sparkSession.range(0, cells, 1, 1).select(
        F.floor(F.col("id") / (forest.n_leaves * n_classes)).cast("int").alias("tree"),
        F.floor(F.pmod("id", F.lit(forest.n_leaves * n_classes)) / n_classes).cast("int").alias("leaf"),
        F.pmod("id", F.lit(n_classes)).cast("int").alias("class"))
    return grid.join(seen, ["tree", "leaf", "class"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0)).cast("bigint"))


def noisy_labels(counts: DataFrame, epsilons: Sequence[float] = EPSILON_GRID,
                 seed: int | str | None = None, monotone: bool = False) -> DataFrame:
    """(epsilon, tree, leaf, label, score) for the whole budget grid in one job.

    Noise has scale 2/epsilon, or 1/epsilon if neighbouring tables only add or remove a row.
    ``seed=None`` draws secret noise.
    """
    bad = [e for e in epsilons if not e > 0]
    if bad:
        raise ValueError(f"epsilon must be positive, got {bad}")
    factor = 1.0 if monotone else 2.0
    grid = F.explode(F.array(*[
        F.struct(F.lit(float(e)).alias("epsilon"), F.lit(i).alias("step"))
        for i, e in enumerate(epsilons)]))
    noise = exponential(secret_seed(seed), "leaf", F.col("_g.step"), "tree", "leaf", "class")
    scored = counts.withColumn("_g", grid).select(
        F.col("_g.epsilon").alias("epsilon"), "tree", "leaf", "class",
        (F.col("n") + noise * F.lit(factor) / F.col("_g.epsilon")).alias("score"))
    best = F.max(F.struct("score", (-F.col("class")).alias("neg")))
    return scored.groupBy("epsilon", "tree", "leaf").agg(best.alias("_b")).select(
        "epsilon", "tree", "leaf", (-F.col("_b.neg")).alias("label"), F.col("_b.score").alias("score"))


def predict(df: DataFrame, forest: Forest, labels: DataFrame, n_classes: int,
            leaves: str = "leaves") -> DataFrame:
    """One row per input row and epsilon with ``probs`` (vote shares) and ``y_pred``.

    The model is trees x leaves labels per epsilon and becomes one literal array per epsilon.
    """
    table: dict[float, list[int]] = {}
    for r in labels.select("epsilon", "tree", "leaf", "label").collect():
        slot = table.setdefault(r["epsilon"], [0] * (forest.n_trees * forest.n_leaves))
        slot[r["tree"] * forest.n_leaves + r["leaf"]] = r["label"]
    models = F.expr("explode(array(" + ", ".join(
        f"named_struct('epsilon', {double(e)}, 'labels', {array_sql(table[e])})" for e in sorted(table)) + "))")
    trees = range(forest.n_trees)
    voted = df.withColumn("_m", models).selectExpr("*", *[
        f"get(_m.labels, {t * forest.n_leaves} + get({leaves}, {t})) AS _v{t}" for t in trees])
    share = lambda c: "(" + " + ".join(f"CAST(_v{t} = {c} AS INT)" for t in trees) + f") / {forest.n_trees}D"
    scored = voted.withColumn("probs", F.expr(f"array({', '.join(share(c) for c in range(n_classes))})"))
    return scored.withColumn("epsilon", F.col("_m.epsilon")).withColumn("y_pred", argmax(F.col("probs"))).drop(
        "_m", *[f"_v{t}" for t in trees])
