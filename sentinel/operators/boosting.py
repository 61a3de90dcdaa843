"""Gradient-boosted trees on distributed histograms: logistic, softmax or one-vs-rest.

Features are binned once at exact quantiles. Rows live as blocks of bin numbers and margins, one per partition, in reliable
lineage. A level of all trees of a round is one pass: every block adds up gradients and Hessians per (tree, node, feature, bin), and
blocks are summed by a tree reduction, or by the driver where they are few and small. Only the smaller child of a split is counted, its sibling is
the parent minus it. A node of at most ``LOCAL_ROWS`` rows, more where there are few features, leaves the levels: once a round the rows of all such
nodes are shuffled by node and each node is grown to its end within one bounded task. Histograms of more than ``DRIVER_BYTES`` stay on the cluster, where they are summed by node, subtracted from those of the level
before and searched; the driver gets the best split of each node. Levels that exceed ``HELD_BYTES`` are counted in several passes.

Gradients are rounded to multiples of 2**-24 and added as whole numbers, so the trees do not depend on the partitioning or on the order
of tasks. Null and NaN features go left.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinel.functions.cols import argmax
from sentinel.functions.storage import cut_lineage, path_exists, shared_dir
from sentinel.operators.ranking import exact_quantiles, vector_to_long

UNIT = float(1 << 24)
CELLS_PER_TASK, LARGEST_BLOCK = 1 << 18, 1 << 26
LOCAL_ROWS, LOCAL_FEATURES = 4096, 64  # rows of a node with this many features or more that one task may grow; in proportion more with fewer
HELD_BYTES = 256 << 20
DRIVER_BYTES = 1 << 19
DIRECT_BYTES = 1 << 22  # of all blocks' histograms together that go straight to the driver
LINEAGE_ROUNDS = 25
LEAST_GAIN = 1e-6
PLACED_ROWS = 1 << 14  # whose places stay in the cache of a core
OBJECTIVES = ("logistic", "softmax", "one_vs_rest")


@dataclass
class Tree:
    """Nodes as parallel lists; a leaf has feature -1. A value above the threshold (a bin above ``bin``) goes right."""

    feature: list[int]
    bin: list[int]
    threshold: list[float]
    left: list[int]
    right: list[int]
    value: list[float]
    gain: list[float]

    @staticmethod
    def leaf() -> Tree:
        return Tree([-1], [0], [0.0], [0], [0], [0.0], [0.0])

    def split(self, node: int, feature: int, at: int, threshold: float, gain: float) -> tuple[int, int]:
        left = len(self.feature)
        for column, empty in ((self.feature, -1), (self.bin, 0), (self.threshold, 0.0), (self.left, 0), (self.right, 0), (self.value, 0.0), (self.gain, 0.0)):
            column += [empty, empty]
        self.feature[node], self.bin[node], self.threshold[node], self.gain[node] = feature, at, threshold, gain
        self.left[node], self.right[node] = left, left + 1
        return left, left + 1

    def places(self, values: np.ndarray, cuts: Sequence) -> np.ndarray:
        """Leaf of every column of ``values`` (features x rows), with ``cuts`` per node in the same measure."""
        feature, limit, n = np.array(self.feature), np.array(cuts), values.shape[1]
        inner, own = feature >= 0, np.arange(len(feature))
        child = np.stack([np.where(inner, side, own) for side in (self.left, self.right)], axis=1).ravel()  # a leaf leads to itself
        first, flat, out = np.where(inner, feature, 0) * n, values.ravel(), np.zeros(n, np.int64)
        steps, reached = 0, np.flatnonzero(inner[:1])
        while len(reached):
            steps, reached = steps + 1, child.reshape(-1, 2)[reached].ravel()
            reached = reached[inner[reached]]
        for begin in range(0, n, PLACED_ROWS):
            at = out[begin:begin + PLACED_ROWS]
            rows = np.arange(begin, begin + len(at))
            for _ in range(steps):
                above = flat.take(first.take(at) + rows) > limit.take(at)
                at = child.take(2 * at + above)
            out[begin:begin + PLACED_ROWS] = at
        return out


@dataclass(frozen=True)
class Rule:
    """How trees grow."""

    depth: int
    rate: float
    l2: float
    least_child: float
    bins: int


@dataclass(frozen=True)
class Boosted:
    """``trees[round][group]``: one group for the logistic objective, one per class otherwise."""

    n_classes: int
    objective: str
    trees: tuple[tuple[Tree, ...], ...]
    passes: int = 0

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """One row per row of ``x``; NaN goes left."""
        values = np.ascontiguousarray(x.T)
        margins = np.zeros((len(self.trees[0]) if self.trees else _groups(self.objective, self.n_classes), len(x)))
        for group in self.trees:
            for k, tree in enumerate(group):
                margins[k] += np.array(tree.value)[tree.places(values, tree.threshold)]
        return _probabilities(margins, self.objective).T


def _groups(objective: str, n_classes: int) -> int:
    return 1 if objective == "logistic" else n_classes


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))


def _softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=0))
    return e / e.sum(axis=0)


def _probabilities(margins: np.ndarray, objective: str) -> np.ndarray:
    if objective == "softmax":
        return _softmax(margins)
    each = _sigmoid(margins)
    return np.vstack([1.0 - each, each]) if objective == "logistic" else each / np.maximum(each.sum(axis=0), 1e-300)


def gradients(margins: np.ndarray, y: np.ndarray, objective: str) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and Hessians per group and row, as whole multiples of 1 / UNIT."""
    if objective == "logistic":
        p, hit = _sigmoid(margins), (y == 1)[None, :]
    else:
        p, hit = (_softmax if objective == "softmax" else _sigmoid)(margins), y[None, :] == np.arange(len(margins))[:, None]
    factor = 2.0 if objective == "softmax" else 1.0
    return np.rint((p - hit) * UNIT), np.rint(np.maximum(factor * p * (1.0 - p), 1e-6) * UNIT)


Node = tuple[int, int]  # group and number
Proposal = tuple[Node, tuple[float, int, int], tuple[int, int], tuple[int, int]]
Block = tuple[np.ndarray, np.ndarray, np.ndarray]  # bins (features x rows), labels, margins (groups x rows)


def _histogram(at: np.ndarray, rows: np.ndarray, slot: np.ndarray, g: np.ndarray, h: np.ndarray, slots: int, bins: int) -> np.ndarray:
    """(slot, feature, bin, [gradient, Hessian, rows]) of the chosen rows."""
    out = np.empty((slots, len(at), bins, 3), np.int64)
    first, gradient, hessian, size = slot * bins, g[rows], h[rows], slots * bins
    for f in range(len(at)):
        cell = first + at[f][rows]
        out[:, f, :, 0] = np.bincount(cell, gradient, size).reshape(slots, bins)
        out[:, f, :, 1] = np.bincount(cell, hessian, size).reshape(slots, bins)
        out[:, f, :, 2] = np.bincount(cell, minlength=size).reshape(slots, bins)
    return out


def _slots(tree: Tree, at: np.ndarray, nodes: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows that lie in ``nodes``, and the number of their node."""
    slot_of = np.full(len(tree.feature), -1, np.int64)
    slot_of[list(nodes)] = np.arange(len(nodes))
    slot = slot_of[tree.places(at, tree.bin)] if len(tree.feature) > 1 else np.zeros(at.shape[1], np.int64)
    rows = np.flatnonzero(slot >= 0)
    return rows, slot[rows]


def _counted(block: Block, trees: Sequence[Tree], wanted: Sequence[list[int]], bins: int, objective: str) -> np.ndarray:
    """Histograms of one block for the nodes ``wanted[group]``, one group after the other."""
    at, y, margins = block
    g, h = gradients(margins, y, objective)
    parts = [_histogram(at, *_slots(tree, at, nodes), g[k], h[k], len(nodes), bins) for k, (tree, nodes) in enumerate(zip(trees, wanted)) if nodes]
    return np.concatenate(parts)


def _rows_of(block: Block, trees: Sequence[Tree], wanted: Sequence[list[int]], objective: str) -> list:
    """((group, node), (bins, gradients, Hessians)) of the rows of one block in the nodes ``wanted[group]``."""
    at, y, margins = block
    g, h = gradients(margins, y, objective)
    out = []
    for k, (tree, nodes) in enumerate(zip(trees, wanted)):
        if nodes:
            rows, slot = _slots(tree, at, nodes)
            order = np.argsort(slot, kind="stable")
            edges = np.searchsorted(slot[order], np.arange(len(nodes) + 1))
            for i, node in enumerate(nodes):
                mine = rows[order[edges[i]:edges[i + 1]]]
                if len(mine):
                    out.append(((k, node), (at[:, mine], g[k][mine], h[k][mine])))
    return out


def _node_sums(block: Block, trees: Sequence[Tree], wanted: Sequence[list[int]], bins: int, objective: str) -> Iterator[tuple[Node, np.ndarray]]:
    """((group, node), histogram) of one block for the nodes ``wanted[group]``."""
    at, y, margins = block
    g, h = gradients(margins, y, objective)
    for k, (tree, nodes) in enumerate(zip(trees, wanted)):
        if nodes:
            sums = _histogram(at, *_slots(tree, at, nodes), g[k], h[k], len(nodes), bins)
            yield from (((k, n), sums[i].copy()) for i, n in enumerate(nodes))


def _sibling(item: tuple, other: dict) -> tuple[Node, np.ndarray]:
    """The child that was not counted."""
    _, ((node, sums), whole) = item
    return other[node], whole - sums


def _proposal(item: tuple[Node, np.ndarray], rule: Rule, last: bool) -> Proposal:
    """(node, best split, sums of gradient and Hessian, rows left and right of the split)."""
    node, sums = item
    best = (-np.inf, 0, 0) if last else _best_splits(sums[None], rule)[0]
    _, feature, at = best
    return node, best, tuple(sums[0, :, :2].sum(axis=0).tolist()), (int(sums[feature, :at + 1, 2].sum()), int(sums[feature, at + 1:, 2].sum()))


def _decide(tree: Tree, node: int, total: tuple[int, int], found: tuple[float, int, int], rule: Rule, cuts: Sequence[np.ndarray]) -> tuple[int, int] | None:
    """Splits a node, or gives the leaf its value; ``total`` are the node's sums of gradient and Hessian."""
    gain, feature, at = found
    if gain > LEAST_GAIN:
        return tree.split(node, feature, at, float(cuts[feature][at]), gain)
    g, h = (v / UNIT for v in total)
    tree.value[node] = -rule.rate * g / (h + rule.l2)
    return None


def _finished(item: tuple, depths: dict, rule: Rule, cuts: Sequence[np.ndarray]) -> tuple:
    """The subtree below one node, grown from all its rows."""
    key, parts = item
    parts = list(parts)
    at = np.concatenate([p[0] for p in parts], axis=1)
    g, h = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
    tree, active = Tree.leaf(), [0]
    for level in range(depths[key], rule.depth + 1):
        rows, slot = _slots(tree, at, active)
        sums = _histogram(at, rows, slot, g, h, len(active), rule.bins)
        found = _best_splits(sums, rule) if level < rule.depth else [(-np.inf, 0, 0)] * len(active)
        children = [_decide(tree, node, tuple(total[0, :, :2].sum(axis=0).tolist()), best, rule, cuts) for node, total, best in zip(active, sums, found)]
        active = [c for pair in children if pair for c in pair]
        if not active:
            break
    return key, tree


def _advanced(block: Block, trees: Sequence[Tree]) -> Block:
    at, y, margins = block
    moved = [m + np.array(t.value)[t.places(at, t.bin)] for m, t in zip(margins, trees)]
    return at, y, np.stack(moved)


def _best_splits(sums: np.ndarray, rule: Rule) -> list[tuple[float, int, int]]:
    """(gain, feature, bin) of the best split of each node; ties go to the smallest feature, then bin."""
    sums = sums[..., :2]
    total = sums[:, :1].sum(axis=2, keepdims=True) / UNIT
    left = np.cumsum(sums, axis=2)[:, :, :-1] / UNIT
    right = total - left
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + rule.l2)
    gain = score(left) + score(right) - score(total)
    gain[(left[..., 1] < rule.least_child) | (right[..., 1] < rule.least_child)] = -np.inf
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(axis=1)
    return [(float(flat[i, b]), int(b) // gain.shape[2], int(b) % gain.shape[2]) for i, b in enumerate(best)]


def feature_cuts(rows: DataFrame, features: str, bins: int, dim: int) -> list[np.ndarray]:
    """Distinct exact quantiles of every feature: at most bins - 1 cuts each."""
    long = vector_to_long(rows.select(F.transform(features, lambda v: v.cast("double")).alias("x")), "x")
    found = exact_quantiles(long, [i / bins for i in range(1, bins)]).select("feature", "quantile").toArrow()
    feature, value = found["feature"].to_numpy(), found["quantile"].to_numpy()
    return [np.unique(value[feature == f]) for f in range(dim)]


def _blocks(rows: DataFrame, features: str, label: str, cuts: list[np.ndarray], groups: int) -> RDD:
    """One block per partition."""
    dim = len(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, ys = [np.zeros((dim, 0), np.uint8)], [np.zeros(0, np.int32)]
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(b.num_rows, dim)
            clean = np.where(np.isnan(x), -np.inf, x)
            parts.append(np.stack([np.searchsorted(c, clean[:, f], side="left") for f, c in enumerate(cuts)]).astype(np.uint8))
            ys.append(b.column("y").to_numpy().astype(np.int32))
        bins, y = np.concatenate(parts, axis=1), np.concatenate(ys)
        block = pickle.dumps((bins, y, np.zeros((groups, len(y)))), pickle.HIGHEST_PROTOCOL)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], ["block"])

    x = F.transform(features, lambda v: v.cast("double"))
    slim = rows.select(x.alias("x"), F.col(label).cast("int").alias("y"))
    return slim.mapInArrow(run, "block binary").rdd.map(_unpacked)


def _unpacked(row) -> Block:
    return pickle.loads(row["block"])


def train(rows: DataFrame, features: str, label: str, n_classes: int, rounds: int = 100, depth: int = 10, rate: float = 0.3, l2: float = 1.0,
          least_child: float = 1.0, bins: int = 64, objective: str | None = None) -> Boosted:
    """Fit on ``rows``. The objective defaults to logistic for two classes and to softmax for more."""
    objective = objective or ("logistic" if n_classes == 2 else "softmax")
    if objective not in OBJECTIVES or not 2 <= bins <= 256:
        raise ValueError(f"unknown objective '{objective}'" if objective not in OBJECTIVES else f"bins must be 2 to 256, got {bins}")
    spark, groups = rows.sparkSession, _groups(objective, n_classes)
    shared_dir(spark)
    stored = cut_lineage(rows.select(features, label))
    n = stored.count()
    if not n:
        raise ValueError("no rows to train on")
    dim = len(stored.first()[features])
    cuts = feature_cuts(stored, features, bins, dim)
    cells = n * dim * groups
    cores = spark.sparkContext.defaultParallelism
    tasks = max(min(-(-cells // CELLS_PER_TASK), cores), -(-cells // LARGEST_BLOCK))
    held = stored.rdd.getNumPartitions()
    dealt = stored.repartition(tasks) if tasks > held else stored.coalesce(tasks)
    state = _blocks(dealt, features, label, cuts, groups).persist(StorageLevel.MEMORY_AND_DISK)
    grower = _Grower(cuts, groups, n, Rule(depth, rate, l2, least_child, bins), objective, cores)
    done: list[tuple[Tree, ...]] = []
    before: RDD | None = None
    try:
        for number in range(1, rounds + 1):
            done.append(tuple(grower.grow(state)))
            if before is not None:
                before.unpersist()
            before, state = state, state.map(partial(_advanced, trees=done[-1])).persist(StorageLevel.MEMORY_AND_DISK)
            if number % LINEAGE_ROUNDS == 0 and number < rounds:
                state.checkpoint()
                state.count()
    finally:
        state.unpersist()
        if before is not None:
            before.unpersist()
    return Boosted(n_classes, objective, tuple(done), grower.passes)


class _Grower:
    """Grows the trees of one round: large nodes level by level, small ones in one task each."""

    def __init__(self, cuts: list[np.ndarray], groups: int, rows: int, rule: Rule, objective: str, cores: int):
        self.cuts, self.groups, self.rows, self.rule, self.objective, self.cores, self.passes = cuts, groups, rows, rule, objective, cores, 0
        self.size = len(cuts) * rule.bins * 3 * 8  # of a histogram
        self.local = LOCAL_ROWS * max(LOCAL_FEATURES // max(len(cuts), 1), 1)
        self.at_once = max(HELD_BYTES // self.size, 2)

    def _by_group(self, nodes: Sequence[Node]) -> list[list[int]]:
        return [[n for k, n in nodes if k == group] for group in range(self.groups)]

    def _sums(self, state: RDD, trees: list[Tree], nodes: list[Node]) -> dict[Node, np.ndarray]:
        self.passes += 1
        job = partial(_counted, trees=trees, wanted=self._by_group(nodes), bins=self.rule.bins, objective=self.objective)
        direct = state.getNumPartitions() * len(nodes) * self.size <= DIRECT_BYTES
        return dict(zip(nodes, state.map(job).treeReduce(np.add, depth=1 if direct else 2)))

    def _stored_sums(self, state: RDD, trees: list[Tree], nodes: list[Node], other: dict[Node, tuple[Node, Node]], held: RDD | None) -> RDD:
        """Histograms of ``nodes`` on the cluster, and of the siblings in ``other`` (node to parent and sibling) whose parents are ``held``."""
        self.passes += 1
        job = partial(_node_sums, trees=trees, wanted=self._by_group(nodes), bins=self.rule.bins, objective=self.objective)
        parts = min(len(nodes), 2 * self.cores)
        sums = state.flatMap(job).reduceByKey(np.add, parts)
        if other:
            parent = {n: p for n, (p, _) in other.items()}
            sibling = {n: s for n, (_, s) in other.items()}
            counted = sums.filter(lambda kv: kv[0] in parent).map(lambda kv: (parent[kv[0]], kv))
            sums = sums.union(counted.join(held, parts).map(partial(_sibling, other=sibling)))
        return sums.persist(StorageLevel.MEMORY_AND_DISK)

    def grow(self, state: RDD) -> list[Tree]:
        trees = [Tree.leaf() for _ in range(self.groups)]
        small: dict[Node, tuple[int, int]] = {}  # and their levels and rows
        held: dict[Node, np.ndarray] = {}
        stored: list[RDD] = []  # of the level before, with the histograms of ``stored_nodes``
        stored_nodes: set[Node] = set()
        families: list[tuple[Node | None, list[Node]]] = []
        for k in range(self.groups):
            if self.rows <= self.local:
                small[k, 0] = 0, self.rows
            else:
                families.append((None, [(k, 0)]))
        for level in range(self.rule.depth + 1):
            following, next_held, next_stored, next_nodes = [], {}, [], set()
            whole = state.context.union(stored) if stored else None
            propose = partial(_proposal, rule=self.rule, last=level == self.rule.depth)
            while families:
                batch, families = families[:self.at_once // 2], families[self.at_once // 2:]
                # the lighter child is counted; the heavier one, too, if the parent is not at hand
                ask = [m for parent, members in batch for m in (members[:1] if parent in held or parent in stored_nodes else members)]
                kept = None
                if len(ask) * self.size > DRIVER_BYTES or any(parent in stored_nodes for parent, _ in batch):
                    ask += [m for parent, members in batch if parent in held for m in members[1:]]
                    other = {members[0]: (parent, members[1]) for parent, members in batch if parent in stored_nodes}
                    kept = self._stored_sums(state, trees, sorted(ask), other, whole)
                    next_stored.append(kept)
                    found = sorted(kept.map(propose).collect())
                else:
                    sums = self._sums(state, trees, sorted(ask)) if ask else {}
                    for parent, members in batch:
                        if parent in held:
                            for other_child in members[1:]:
                                sums[other_child] = held[parent] - sums[members[0]]
                    found = [propose((n, sums[n])) for n in sorted(sums)]
                for node, best, total, split in found:
                    pair = _decide(trees[node[0]], node[1], total, best, self.rule, self.cuts)
                    if pair is None:
                        continue
                    ordered = sorted(zip(split, ((node[0], c) for c in pair)))
                    for size, child in ordered:
                        if size <= self.local:
                            small[child] = level + 1, size
                    large = [child for size, child in ordered if size > self.local]
                    # the rest of a parent with one small child is that child's complement, but the child is not counted
                    if len(large) == 2 and kept is not None:
                        next_nodes.add(node)
                    elif len(large) == 2 and len(next_held) < self.at_once:
                        next_held[node] = sums[node]
                    if large:
                        following.append((node, large))
            for rdd in stored:
                rdd.unpersist()
            families, held, stored, stored_nodes = following, next_held, next_stored, next_nodes
            if not families:
                break
        for rdd in stored:
            rdd.unpersist()
        if small:
            self._finish(state, trees, small)
        return trees

    def _finish(self, state: RDD, trees: list[Tree], small: dict[Node, tuple[int, int]]) -> None:
        """Grow all small nodes, in one shuffle of their rows, and graft what comes back. The largest nodes are dealt first, each to the least filled task."""
        self.passes += 1
        filled = [(0, task) for task in range(min(len(small), 2 * self.cores))]
        task_of, depths = {}, {node: level for node, (level, _) in small.items()}
        for node, (_, size) in sorted(small.items(), key=lambda item: (-item[1][1], item[0])):
            load, task_of[node] = filled[0]
            heapq.heapreplace(filled, (load + size, task_of[node]))
        rows = state.flatMap(partial(_rows_of, trees=trees, wanted=self._by_group(sorted(small)), objective=self.objective))
        grown = rows.groupByKey(len(filled), task_of.__getitem__).map(partial(_finished, depths=depths, rule=self.rule, cuts=self.cuts)).collect()
        for (k, node), part in sorted(grown, key=lambda g: g[0]):
            tree, base = trees[k], len(trees[k].feature) - 1
            number = lambda i: node if i == 0 else base + i  # noqa: E731, B023
            for i in range(len(part.feature)):
                row = (part.feature[i], part.bin[i], part.threshold[i], number(part.left[i]), number(part.right[i]), part.value[i], part.gain[i])
                for column, value in zip((tree.feature, tree.bin, tree.threshold, tree.left, tree.right, tree.value, tree.gain), row):
                    if i:
                        column.append(value)
                    else:
                        column[node] = value


def predict(df: DataFrame, model: Boosted, features: str = "features") -> DataFrame:
    """Add ``probs`` and ``y_pred``."""

    @F.arrow_udf("array<double>")
    def probabilities(x: pa.Array) -> pa.Array:
        flat = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
        probs = model.probabilities(flat.reshape(len(x), -1)) if len(x) else np.zeros((0, 2))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * probs.shape[1], pa.int32()), pa.array(probs.ravel()))

    doubles = F.transform(features, lambda v: v.cast("double"))
    return df.withColumn("probs", probabilities(doubles)).withColumn("y_pred", argmax(F.col("probs")))


NODES = ("objective string, n_classes int, round int, `group` int, node int, feature int, bin int, threshold double, left int, right int, value double, "
         "gain double")


def nodes(spark: SparkSession, model: Boosted) -> DataFrame:
    """The model as a table, one row per node."""
    rows = [(model.objective, model.n_classes, r, k, i, *(int(c[i]) for c in (t.feature, t.bin)), float(t.threshold[i]), t.left[i], t.right[i],
             float(t.value[i]), float(t.gain[i]))
            for r, group in enumerate(model.trees) for k, t in enumerate(group) for i in range(len(t.feature))]
    return spark.createDataFrame(rows, NODES)


def save(spark: SparkSession, model: Boosted, path: str) -> None:
    nodes(spark, model).coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Boosted:
    """The model stored at ``path``."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no model at {path}; train it first")
    table = spark.read.schema(NODES).parquet(path).orderBy("round", "group", "node").toArrow().to_pylist()
    trees: dict[int, dict[int, Tree]] = {}
    for r in table:
        t = trees.setdefault(r["round"], {}).setdefault(r["group"], Tree([], [], [], [], [], [], []))
        for name in ("feature", "bin", "threshold", "left", "right", "value", "gain"):
            getattr(t, name).append(r[name])
    return Boosted(table[0]["n_classes"], table[0]["objective"], tuple(tuple(g[k] for k in sorted(g)) for _, g in sorted(trees.items())))


def importances(model: Boosted, dim: int) -> np.ndarray:
    """Mean gain of a feature's splits, as shares of one."""
    gain, uses = np.zeros(dim), np.zeros(dim)
    for group in model.trees:
        for t in group:
            for f, g in zip(t.feature, t.gain):
                if f >= 0:
                    gain[f] += g
                    uses[f] += 1
    mean = gain / np.maximum(uses, 1)
    return mean / mean.sum() if mean.sum() else mean
