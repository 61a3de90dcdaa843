"""Random forests on distinct binned rows: bootstrap, balanced classes, Gini gain, a draw of features per node.

Features are binned once. Rows with the same bins and class cannot be told apart by any split, so they are counted into one cell, and a tree's
bootstrap gives a cell of n rows a weight of Poisson(n), the sum of n rows' Poisson(1). The work after that grows with the cells: at most the
rows, and at most classes x the product of the bins, however many rows there are. A level of all trees is one pass over the cells: every block
counts classes per (tree, node, drawn feature, bin), the counts of a tree meet in one task, and the driver gets the best split of each node.

Cuts: all midpoints of a feature with at most ``bins`` distinct values; else quantiles at which all classes weigh the same, from exact quantiles of
each class. Counts are whole numbers and draws depend on cells, trees and nodes only, so a forest does not depend on the partitioning. Null and NaN
features go left, with the smallest values.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinel.functions.storage import cut_lineage
from sentinel.operators.boosting import Tree
from sentinel.operators.ranking import exact_quantiles

MAX_CLASSES = 100
DRAWS_PER_TASK, LARGEST_BLOCK = 1 << 18, 1 << 25
HELD_CELLS = 1 << 25
LEAST_SHARE = 1e-12  # of a node's weight: smaller gains are rounding


@dataclass(frozen=True)
class Forest:
    """``counts[tree][node]``: weight of each class in the node. A tree's ``gain`` is the impurity decrease times the node's weight."""

    n_classes: int
    trees: tuple[Tree, ...]
    counts: tuple[np.ndarray, ...]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Mean of the trees' class shares, one row per row of ``x``."""
        values, votes = np.ascontiguousarray(x.T), np.zeros((len(x), self.n_classes))
        for tree, counts in zip(self.trees, self.counts):
            shares = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1e-300)
            votes += shares[tree.places(values, tree.threshold)]
        return votes / np.maximum(votes.sum(axis=1, keepdims=True), 1e-300)


def _few_values(batches: Iterator[pa.RecordBatch], dim: int, bins: int) -> Iterator[pa.RecordBatch]:
    """(feature, value): the distinct values of a partition, or bins + 1 of them where there are more."""
    seen = [np.zeros(0)] * dim
    for b in batches:
        x = _matrix(b, dim)
        for f in range(dim):
            if len(seen[f]) <= bins:
                found = np.union1d(seen[f], x[:, f])
                seen[f] = found[~np.isnan(found)][:bins + 1]
    feature = np.repeat(np.arange(dim), [len(s) for s in seen])
    yield pa.RecordBatch.from_arrays([pa.array(feature, pa.int32()), pa.array(np.concatenate(seen))], ["feature", "value"])


def _matrix(b: pa.RecordBatch, dim: int) -> np.ndarray:
    return b.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(b.num_rows, dim)


def feature_cuts(rows: DataFrame, dim: int, bins: int) -> list[np.ndarray]:
    """At most bins - 1 cuts for each feature of ``rows(x, y)``; a value above a cut lies right of it."""
    few = rows.select("x").mapInArrow(partial(_few_values, dim=dim, bins=bins), "feature int, value double").distinct().toArrow()
    feature, value = few["feature"].to_numpy(), few["value"].to_numpy()
    values = [np.unique(value[feature == f]) for f in range(dim)]
    many = [f for f in range(dim) if len(values[f]) > bins]
    pools: dict[int, list[float]] = {f: [] for f in many}
    if many:
        wanted = F.array(*[F.struct(F.lit(f).alias("f"), F.get("x", F.lit(f)).alias("value")) for f in many])
        long = rows.select("y", F.inline(wanted)).select((F.col("y") * dim + F.col("f")).alias("feature"), "value")
        for r in exact_quantiles(long, [i / bins for i in range(1, bins)]).collect():
            pools[r["feature"] % dim].append(r["quantile"])
    shares = [i / bins for i in range(1, bins)]
    return [np.unique(np.quantile(pools[f], shares, method="inverted_cdf")) if f in pools else _middles(values[f]) for f in range(dim)]


def _middles(v: np.ndarray) -> np.ndarray:
    """Between neighbours; the lower one where no finite number lies between them."""
    with np.errstate(invalid="ignore"):
        middle = v[:-1] / 2 + v[1:] / 2
    return np.where(np.isfinite(middle) & (middle < v[1:]), middle, v[:-1])


def _binned(batches: Iterator[pa.RecordBatch], cuts: Sequence[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(bins, y): one byte per feature."""
    for b in batches:
        x = _matrix(b, len(cuts))
        clean = np.where(np.isnan(x), -np.inf, x)
        at = np.stack([np.searchsorted(c, clean[:, f], side="left") for f, c in enumerate(cuts)], axis=1).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([row.tobytes() for row in at], pa.binary()), b.column("y")], ["bins", "y"])


Block = tuple[np.ndarray, np.ndarray, np.ndarray]  # bins (features x cells), classes, draws (trees x cells)


def _drawn(batches: Iterator[pa.RecordBatch], dim: int, n_trees: int, seed: int) -> Iterator[pa.RecordBatch]:
    """One block per partition; the draws of a cell depend on its key only."""
    bins, ys, draws = [np.zeros((0, dim), np.uint8)], [np.zeros(0, np.int32)], [np.zeros((0, n_trees), np.uint8)]
    for b in batches:
        bins.append(np.frombuffer(b"".join(b.column("bins").to_pylist()), np.uint8).reshape(b.num_rows, dim))
        ys.append(b.column("y").to_numpy())
        keys = np.full((b.num_rows, 2), seed % (1 << 64), np.uint64)
        keys[:, 0] = b.column("key").to_numpy().view(np.uint64)
        each = [np.random.Generator(np.random.Philox(key=k)).poisson(n, n_trees) for k, n in zip(keys, b.column("n").to_numpy())]
        found = np.stack(each) if each else np.zeros((0, n_trees), np.int64)
        draws.append(found.astype(np.min_scalar_type(int(found.max(initial=0)))))
    turned = (np.ascontiguousarray(np.concatenate(p).T) for p in (bins, ys, draws))
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(tuple(turned), pickle.HIGHEST_PROTOCOL)], pa.binary())], ["block"])


def _unpacked(row) -> Block:
    return pickle.loads(row["block"])


@dataclass(frozen=True)
class _Shape:
    """What the tasks of a level need to know."""

    dim: int
    drawn: int  # features per node
    bins: int
    n_classes: int
    seed: int

    def features_of(self, tree: int, level: int, nodes: int) -> np.ndarray:
        """The features drawn for each node (nodes x drawn), ascending."""
        rng = np.random.default_rng([self.seed % (1 << 64), tree, level])
        return np.sort(rng.permuted(np.tile(np.arange(self.dim), (nodes, 1)), axis=1)[:, :self.drawn], axis=1)


Level = dict[int, tuple[Tree, np.ndarray]]  # tree number to the tree so far and its open nodes


def _counted(block: Block, level: int, open_nodes: Level, shape: _Shape) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    """(tree, (cell numbers, counts)), where cells are (node, drawn feature, bin, class)."""
    at, y, draws = block
    for number, (tree, nodes) in open_nodes.items():
        slot_of = np.full(len(tree.feature), -1, np.int64)
        slot_of[nodes] = np.arange(len(nodes))
        slot = slot_of[tree.places(at, tree.bin)]
        rows = np.flatnonzero((slot >= 0) & (draws[number] > 0))
        slot, drawn = slot[rows], shape.features_of(number, level, len(nodes))
        cells = np.empty((len(nodes), shape.drawn, shape.bins * shape.n_classes), np.int64)
        for j in range(shape.drawn):
            cell = (slot * shape.bins + at[drawn[slot, j], rows]) * shape.n_classes + y[rows]
            cells[:, j] = np.bincount(cell, draws[number][rows], len(nodes) * cells.shape[2]).reshape(len(nodes), -1)
        flat = cells.ravel()
        some = np.flatnonzero(flat)
        yield number, (some.astype(np.min_scalar_type(len(flat))), flat[some].astype(np.min_scalar_type(int(flat.max(initial=0)))))


def _searched(items: Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]], level: int, sizes: dict[int, int], shape: _Shape, weight: np.ndarray) -> Iterator[tuple]:
    """(tree, gain, feature, bin, class counts left of the split, class counts) of the open nodes of each tree."""
    sums: dict[int, np.ndarray] = {}
    for number, (some, counts) in items:
        if number not in sums:
            sums[number] = np.zeros(sizes[number] * shape.drawn * shape.bins * shape.n_classes, np.int64)
        sums[number][some] += counts
    for number in sorted(sums):
        whole = sums.pop(number).reshape(sizes[number], shape.drawn, shape.bins, shape.n_classes)
        left = np.cumsum(whole, axis=2)
        total = left[:, :1, -1:]
        gain = _purity(left, weight) + _purity(total - left, weight) - _purity(total, weight)
        flat = gain.reshape(len(gain), -1)
        best, slots = flat.argmax(axis=1), np.arange(len(flat))
        j, cut = best // shape.bins, best % shape.bins
        feature = shape.features_of(number, level, len(flat))[slots, j]
        yield number, flat[slots, best], feature, cut, left[slots, j, cut], total[:, 0, 0]


def _purity(counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weight times the sum of squared class shares; a side without rows gains nothing."""
    w = counts * weight
    return (w * w).sum(axis=-1) / np.maximum(w.sum(axis=-1), 1e-300)


def _blocks(cells: DataFrame, n_cells: int, dim: int, n_trees: int, seed: int) -> RDD:
    cores = cells.sparkSession.sparkContext.defaultParallelism
    draws = n_cells * n_trees
    tasks = max(min(-(-draws // DRAWS_PER_TASK), 2 * cores), -(-draws // LARGEST_BLOCK))
    made = cells.repartition(tasks).mapInArrow(partial(_drawn, dim=dim, n_trees=n_trees, seed=seed), "block binary")
    return made.rdd.map(_unpacked).persist(StorageLevel.MEMORY_AND_DISK)


def train(rows: DataFrame, features: str, label: str, n_trees: int = 100, depth: int = 10, seed: int = 42, bins: int = 32) -> Forest:
    """Fit on ``rows``, whose labels are 0 to K - 1. Each node chooses among the root of the number of features, rounded up."""
    if n_trees < 1 or depth < 1 or not 2 <= bins <= 256:
        raise ValueError(f"need a tree, a level and 2 to 256 bins, got {n_trees}, {depth} and {bins}")
    doubles = F.transform(features, lambda v: v.cast("double"))
    stored = cut_lineage(rows.select(doubles.alias("x"), F.col(label).cast("int").alias("y")))
    sizes = {r["y"]: r["count"] for r in stored.groupBy("y").count().limit(MAX_CLASSES + 1).collect()}
    if not sizes:
        raise ValueError("no rows to train on")
    if None in sizes or min(sizes) < 0 or max(sizes) >= MAX_CLASSES:
        raise ValueError(f"labels must be 0 to {MAX_CLASSES - 1}")
    k, n, dim = max(sizes) + 1, sum(sizes.values()), len(stored.first()["x"])
    weight = np.array([n / (len(sizes) * sizes[c]) if c in sizes else 0.0 for c in range(k)])
    cuts = feature_cuts(stored, dim, bins)
    binned = stored.mapInArrow(partial(_binned, cuts=cuts), "bins binary, y int")
    cells = cut_lineage(binned.groupBy("bins", "y").agg(F.count(F.lit(1)).alias("n")).withColumn("key", F.xxhash64("bins", "y")))
    shape = _Shape(dim, int(np.ceil(np.sqrt(dim))), bins, k, seed)
    state = _blocks(cells, cells.count(), dim, n_trees, seed)
    try:
        return _grown(state, cuts, shape, weight, n_trees, depth)
    finally:
        state.unpersist()


def _grown(state: RDD, cuts: Sequence[np.ndarray], shape: _Shape, weight: np.ndarray, n_trees: int, depth: int) -> Forest:
    trees = [Tree.leaf() for _ in range(n_trees)]
    counts = [[np.zeros(shape.n_classes)] for _ in trees]
    nodes = {t: np.zeros(1, np.int64) for t in range(n_trees)}
    for level in range(depth):
        following: dict[int, np.ndarray] = {}
        for some in _passes(nodes, shape):
            for number, gain, feature, at, left, total in _level(state, trees, some, level, shape, weight):
                tree, sides, whole = trees[number], np.stack([left, total - left], axis=1), total * weight
                if level == 0:
                    counts[number] = [whole[0]]
                split = np.flatnonzero(gain > LEAST_SHARE * whole.sum(axis=1))
                pairs = np.array([tree.split(int(some[number][i]), int(feature[i]), int(at[i]), float(cuts[feature[i]][at[i]]), float(gain[i])) for i in split], np.int64)
                counts[number].extend((sides[split] * weight).reshape(-1, shape.n_classes))
                mixed = np.count_nonzero(sides[split], axis=2) > 1
                if mixed.any():
                    following[number] = pairs[mixed]
        nodes = dict(sorted(following.items()))
        if not nodes:
            break
    return Forest(shape.n_classes, tuple(trees), tuple(np.stack(c) for c in counts))


def _passes(nodes: dict[int, np.ndarray], shape: _Shape) -> Iterator[dict[int, np.ndarray]]:
    """The open nodes in lots of whole trees, whose counts a task can hold."""
    some, held = {}, 0
    for number, open_nodes in nodes.items():
        size = len(open_nodes) * shape.drawn * shape.bins * shape.n_classes
        if some and held + size > HELD_CELLS:
            yield some
            some, held = {}, 0
        some[number], held = open_nodes, held + size
    if some:
        yield some


def _level(state: RDD, trees: Sequence[Tree], nodes: dict[int, np.ndarray], level: int, shape: _Shape, weight: np.ndarray) -> list[tuple]:
    """The best splits of ``nodes``, one pass over the cells."""
    count = partial(_counted, level=level, open_nodes={t: (_slim(trees[t]), n) for t, n in nodes.items()}, shape=shape)
    search = partial(_searched, level=level, sizes={t: len(n) for t, n in nodes.items()}, shape=shape, weight=weight)
    tasks = min(len(nodes), 2 * state.context.defaultParallelism)
    return state.flatMap(count).partitionBy(tasks).mapPartitions(search).collect()


def _slim(tree: Tree) -> Tree:
    """What a task needs to place cells, as arrays."""
    return Tree(*(np.array(c, np.int32) for c in (tree.feature, tree.bin)), [], *(np.array(c, np.int32) for c in (tree.left, tree.right)), [], [])


NODES = "n_classes int, tree int, node int, feature int, bin int, threshold double, left int, right int, gain double, counts array<double>"


def nodes(spark: SparkSession, model: Forest) -> DataFrame:
    """The model as a table, one row per node."""
    rows = [(model.n_classes, k, i, t.feature[i], t.bin[i], t.threshold[i], t.left[i], t.right[i], t.gain[i], counts[i].tolist())
            for k, (t, counts) in enumerate(zip(model.trees, model.counts)) for i in range(len(t.feature))]
    return spark.createDataFrame(rows, NODES)


def save(spark: SparkSession, model: Forest, path: str) -> None:
    nodes(spark, model).coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Forest:
    """The model stored at ``path``."""
    trees: dict[int, Tree] = {}
    counts: dict[int, list] = {}
    table = spark.read.schema(NODES).parquet(path).orderBy("tree", "node").toArrow().to_pylist()
    for r in table:
        t = trees.setdefault(r["tree"], Tree([], [], [], [], [], [], []))
        for name in ("feature", "bin", "threshold", "left", "right", "gain"):
            getattr(t, name).append(r[name])
        t.value.append(0.0)
        counts.setdefault(r["tree"], []).append(r["counts"])
    return Forest(table[0]["n_classes"], tuple(trees.values()), tuple(np.array(c) for c in counts.values()))


def importances(model: Forest, dim: int) -> np.ndarray:
    """Impurity decrease of a feature's splits as a share of each tree's, averaged over trees."""
    total = np.zeros(dim)
    for t in model.trees:
        feature, gain = np.array(t.feature), np.array(t.gain)
        own = np.bincount(feature[feature >= 0], gain[feature >= 0], dim)
        total += own / own.sum() if own.sum() else own
    return total / total.sum() if total.sum() else total
