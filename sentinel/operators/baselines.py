"""Non-private classifiers (MLlib, and trees of our own), all returning ``probs`` arrays and integer ``y_pred``."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, RandomForestClassificationModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinel.functions.storage import path_exists
from sentinel.operators import boosting, forest
from sentinel.operators.sample import add_class_weight

Fitted = Model | boosting.Boosted | forest.Forest


def _vectors(df: DataFrame, features: str) -> DataFrame:
    as_double = F.transform(features, lambda v: v.cast("double"))
    return df.withColumn("_vec", array_to_vector(as_double))


def train_logistic(train: DataFrame, features: str, label: str, c: float = 1.0,
                   max_iter: int = 1000) -> Model:
    """L2, balanced weights, multinomial beyond two classes."""
    n = train.count()
    weighted = _vectors(add_class_weight(train, label), features)
    return LogisticRegression(
        featuresCol="_vec", labelCol=label, weightCol="weight", regParam=1.0 / (c * n),
        elasticNetParam=0.0, standardization=False, maxIter=max_iter).fit(weighted)


def train_forest(train: DataFrame, features: str, label: str, n_trees: int = 100, depth: int = 10,
                 seed: int = 42) -> forest.Forest:
    """Bootstrap, balanced weights, the root of the number of features per node."""
    return forest.train(train, features, label, n_trees, depth, seed)


def train_boosted(train: DataFrame, features: str, label: str, n_classes: int, rounds: int = 100, depth: int = 10,
                  objective: str | None = None) -> boosting.Boosted:
    """Boosted trees without class weights: logistic for two classes, softmax beyond, or one-vs-rest on request."""
    return boosting.train(train, features, label, n_classes, rounds, depth, objective=objective)


def predict(model: Fitted, df: DataFrame, features: str) -> DataFrame:
    """Add ``probs`` and ``y_pred``."""
    if isinstance(model, (boosting.Boosted, forest.Forest)):
        return boosting.predict(df, model, features)
    out = model.transform(_vectors(df, features)).withColumn("probs", vector_to_array("probability"))
    return out.withColumn("y_pred", F.col("prediction").cast("int")).drop(
        "_vec", "rawPrediction", "probability", "prediction")


MODEL_CLASSES = {c.__name__: c for c in (LogisticRegressionModel, RandomForestClassificationModel)}


def save_model(model: Fitted, path: str) -> None:
    if isinstance(model, boosting.Boosted):
        boosting.save(SparkSession.active(), model, path)
    elif isinstance(model, forest.Forest):
        forest.save(SparkSession.active(), model, path)
    else:
        model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str) -> Fitted:
    """The fitted model saved at ``path``, whichever family it is of."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no model at {path}; train it first")
    if not path_exists(spark, f"{path.rstrip('/')}/metadata"):
        return (forest if "counts" in spark.read.parquet(path).columns else boosting).load(spark, path)
    described = json.loads(spark.read.text(f"{path.rstrip('/')}/metadata").first()[0])
    return MODEL_CLASSES[described["class"].rsplit(".", 1)[-1]].load(path)


def feature_importances(model: Fitted, df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(feature, importance), largest first."""
    if isinstance(model, (boosting.Boosted, forest.Forest)):
        shares = (boosting if isinstance(model, boosting.Boosted) else forest).importances(model, len(names))
    else:
        shares = model.featureImportances.toArray()
    rows = [(n, float(v)) for n, v in zip(names, shares)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature")
