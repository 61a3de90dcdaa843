"""Store of trained models: one folder per (data set, label type, family, epsilon), each with a commit log.

A model's files are written first and its commit, the manifest, last: a job that dies leaves no half model, and a sweep that starts again trains
only what has no manifest. Custom models are Parquet tables of named vectors, boosted trees and forests a table of nodes, MLlib models their own folders.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentinel.functions.storage import list_dir
from sentinel.operators import baselines, boosting, dp_forest, dp_linear, dp_mlp, forest
from sentinel.schema import DP_MODELS
from sentinel.sources.commits import CommitLog

MANIFEST = T.StructType([
    T.StructField("dataset", T.StringType()),
    T.StructField("label_type", T.StringType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("epsilon", T.DoubleType()),
    T.StructField("fingerprint", T.StringType()),
    T.StructField("actual_epsilon", T.DoubleType()),
    T.StructField("train_time_s", T.DoubleType()),
    T.StructField("n_parameters", T.LongType()),
    T.StructField("version", T.LongType()),
])
NO_BUDGET = "none"


@dataclass(frozen=True)
class PrivateForest:
    """A private forest at one budget: its splits, the bounds they lie in, and the label of every leaf (trees one after the other)."""

    forest: dp_forest.Forest
    lower: tuple[float, ...]
    upper: tuple[float, ...]
    labels: tuple[int, ...]
    n_classes: int


Stored = Model | boosting.Boosted | forest.Forest | dp_linear.LinearModels | dp_mlp.Mlp | PrivateForest


def _vectors_of(model: Stored) -> dict[str, Sequence[float]]:
    """The named vectors that a custom model consists of."""
    if isinstance(model, dp_linear.LinearModels):
        weights = model.weights[0]
        return {"kind": [0], "shape": weights.shape, "weights": weights.ravel(), "n_classes": [model.n_classes], "norm_bound": [model.norm_bound],
                "passes": [model.passes], "residuals": model.residuals}
    if isinstance(model, dp_mlp.Mlp):
        return {"kind": [1], "shapes": np.array(model.shapes).ravel(), "theta": model.theta, "epsilons": [model.epsilon, model.actual_epsilon, model.delta, model.sigma],
                "history": model.history}
    return {"kind": [2], "depth": [model.forest.depth, model.forest.n_trees], "features": np.array(model.forest.features).ravel(),
            "positions": np.array(model.forest.positions).ravel(), "lower": model.lower, "upper": model.upper, "labels": model.labels, "n_classes": [model.n_classes]}


def _from_vectors(v: dict[str, list[float]], epsilon: float | None) -> Stored:
    if v["kind"][0] == 0:
        shape = tuple(int(n) for n in v["shape"])
        return dp_linear.LinearModels((epsilon,), (np.array(v["weights"]).reshape(shape),), int(v["n_classes"][0]), v["norm_bound"][0], int(v["passes"][0]), tuple(v["residuals"]))
    if v["kind"][0] == 1:
        shapes = tuple((int(i), int(o)) for i, o in zip(v["shapes"][::2], v["shapes"][1::2]))
        return dp_mlp.Mlp(shapes, np.array(v["theta"]), *v["epsilons"], tuple(v["history"]))
    depth, trees = (int(n) for n in v["depth"])
    rows = lambda name, cast: tuple(tuple(cast(x) for x in part) for part in np.array(v[name]).reshape(trees, -1).tolist())
    return PrivateForest(dp_forest.Forest(depth, rows("features", int), rows("positions", float)), tuple(v["lower"]), tuple(v["upper"]),
                         tuple(int(x) for x in v["labels"]), int(v["n_classes"][0]))


def n_parameters(model: Stored) -> int:
    """Numbers that the model consists of: weights, or nodes of trees, or labels of leaves."""
    if isinstance(model, boosting.Boosted):
        return sum(len(t.feature) for group in model.trees for t in group)
    if isinstance(model, forest.Forest):
        return sum(len(t.feature) for t in model.trees)
    if isinstance(model, Model):
        return model.totalNumNodes if hasattr(model, "totalNumNodes") else model.coefficientMatrix.numRows * model.coefficientMatrix.numCols + len(model.interceptVector)
    if isinstance(model, PrivateForest):
        return len(model.labels)
    return model.theta.size if isinstance(model, dp_mlp.Mlp) else model.weights[0].size


@dataclass(frozen=True)
class ModelStore:
    spark: SparkSession
    root: str

    def _log(self, dataset: str, label_type: str, model_name: str, epsilon: float | None) -> CommitLog:
        if model_name in DP_MODELS and epsilon is None:
            raise ValueError(f"{model_name} needs an epsilon")
        budget = NO_BUDGET if epsilon is None else repr(float(epsilon))
        return CommitLog(self.spark, f"{self.root.rstrip('/')}/{dataset}/{label_type}/{model_name}/epsilon={budget}")

    def manifest(self, dataset: str, label_type: str, model_name: str, epsilon: float | None) -> dict | None:
        """What is known about a finished model; None if there is none."""
        return self._log(dataset, label_type, model_name, epsilon).last()[1]

    def save(self, model: Stored, dataset: str, label_type: str, model_name: str, epsilon: float | None, fingerprint: str,
             train_time_s: float | None = None, actual_epsilon: float | None = None) -> None:
        log = self._log(dataset, label_type, model_name, epsilon)
        folder = log.new_folder("model")
        path = f"{log.root}/{folder}"
        if isinstance(model, (Model, boosting.Boosted, forest.Forest)):
            baselines.save_model(model, path)
        else:
            rows = [(name, [float(x) for x in values]) for name, values in _vectors_of(model).items()]
            self.spark.createDataFrame(rows, "name string, values array<double>").coalesce(1).write.parquet(path)
        entry = {"folder": folder, "dataset": dataset, "label_type": label_type, "model_name": model_name, "epsilon": epsilon, "fingerprint": fingerprint,
                 "actual_epsilon": actual_epsilon, "train_time_s": train_time_s, "n_parameters": int(n_parameters(model))}
        while not log.append(log.last()[0], entry):
            pass

    def load(self, dataset: str, label_type: str, model_name: str, epsilon: float | None = None) -> Stored:
        log = self._log(dataset, label_type, model_name, epsilon)
        entry = log.last()[1]
        if entry is None:
            raise FileNotFoundError(f"{model_name} (epsilon={epsilon}) is not trained for {dataset}, {label_type}")
        if model_name not in DP_MODELS:
            return baselines.load_model(self.spark, log.folder(entry))
        vectors = {r["name"]: list(r["values"]) for r in self.spark.read.parquet(log.folder(entry)).collect()}
        return _from_vectors(vectors, epsilon)

    def listing(self) -> DataFrame:
        """One row per finished model, from the manifests."""
        rows, root = [], self.root.rstrip("/")
        for path in _leaves(self.spark, root, 4):
            number, entry = CommitLog(self.spark, path).last()
            if entry is not None:
                rows.append(tuple(entry[f] for f in MANIFEST.fieldNames()[:-1]) + (number,))
        return self.spark.createDataFrame(rows, MANIFEST)


def _leaves(spark: SparkSession, path: str, depth: int) -> list[str]:
    if not depth:
        return [path]
    return [leaf for name in list_dir(spark, path) for leaf in _leaves(spark, f"{path}/{name}", depth - 1)]


def predict_forests(df: DataFrame, models: dict[float, PrivateForest], features: str = "features") -> DataFrame:
    """Probabilities of private forests of several budgets that share their splits: each row descends once."""
    first = next(iter(models.values()))
    inputs = [f"get({features}, {i})" for i in range(len(first.lower))]
    spark, leaves = df.sparkSession, first.forest.n_leaves
    labels = spark.createDataFrame([(float(e), i // leaves, i % leaves, c) for e, m in models.items() for i, c in enumerate(m.labels)],
                                   "epsilon double, tree int, leaf int, label int")
    rows = dp_forest.route(df, first.forest, inputs, first.lower, first.upper)
    return dp_forest.predict(rows, first.forest, labels, first.n_classes)


def label_vectors(labels: DataFrame) -> dict[float, tuple[int, ...]]:
    """Leaf labels per budget, trees one after the other."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("tree", "leaf", "label"))), lambda s: s["label"])
    return {r["epsilon"]: tuple(r["labels"]) for r in labels.groupBy("epsilon").agg(ordered.alias("labels")).collect()}
