"""Predictions of all runs to result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinel.operators.metrics import evaluate

RUN_COLUMNS = ("run_id", "dataset", "label_type", "model_name", "epsilon")


def result_rows(preds: DataFrame, runs: DataFrame | None = None, label_type: str = "binary",
                auc: bool = True) -> DataFrame:
    """One row per run and split: run columns, metrics and, with ``runs``, training metadata.

    ``preds`` carries the run columns, ``split``, ``y_true``, ``y_pred`` and ``probs``; ``runs`` has
    one row per run_id with delta, actual_epsilon and train_time_s.
    """
    scored = evaluate(preds, ["run_id", "split"], label_type, auc)
    names = preds.select(*RUN_COLUMNS).distinct() if runs is None else runs
    return scored.join(names, "run_id")


def score_runs(scored: DataFrame, dataset: str, label_type: str, model_name: str) -> DataFrame:
    """Predictions of one family as rows of the long predictions table."""
    eps = F.col("epsilon") if "epsilon" in scored.columns else F.lit(None).cast("double")
    run = F.concat_ws("/", F.lit(dataset), F.lit(label_type), F.lit(model_name), eps.cast("string"))
    return scored.select(
        run.alias("run_id"), F.lit(dataset).alias("dataset"), F.lit(label_type).alias("label_type"),
        F.lit(model_name).alias("model_name"), eps.alias("epsilon"), "row_id", "split", "y_true",
        "y_pred", "probs")


SCALARS = ("accuracy", "f1_macro", "f1_weighted", "precision_macro", "recall_macro", "mcc", "roc_auc",
           "false_positive_rate", "detection_rate", "false_negative_rate")


def summarise(results: DataFrame) -> DataFrame:
    """One flat row per run and split: the run's columns and every scalar metric."""
    return results.select("run_id", "dataset", "label_type", "model_name", "epsilon", "split", *SCALARS)
