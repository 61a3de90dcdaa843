"""Evaluation of predictions, for all runs and splits in one job.

Input is a long table with grouping ``keys`` (such as run_id and split), ``y_true``, ``y_pred`` and
optionally ``probs``. Everything but the ROC-AUC derives from the confusion counts, which have a few
rows per run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentinel.functions.cols import ratio, rnd
from sentinel.functions.joins import join_null_safe
from sentinel.functions.storage import cut_lineage
from sentinel.operators import curves
from sentinel.operators.ranking import mean_over_classes
from sentinel.schema import check_label_type

SCALARS = ("accuracy", "f1_macro", "f1_weighted", "precision_macro", "recall_macro", "mcc")
BINARY_RATES = ("false_positive_rate", "detection_rate", "false_negative_rate")


def confusion(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long confusion counts (keys, y_true, y_pred, n)."""
    return preds.groupBy(*keys, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def confusion_dense(conf: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every (y_true, y_pred) pair over the labels seen in a run, zeros included, with row shares."""
    keys = list(keys)
    labels = conf.groupBy(*keys).agg(F.array_sort(F.array_union(
        F.collect_set("y_true"), F.collect_set("y_pred"))).alias("_labels"))
    grid = (
        labels.withColumn("y_true", F.explode("_labels"))
        .withColumn("y_pred", F.explode("_labels")).drop("_labels")
    )
    full = grid.join(conf, [*keys, "y_true", "y_pred"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0)).cast("bigint"))
    row = F.sum("n").over(Window.partitionBy(*keys, "y_true"))
    whole = F.sum("n").over(Window.partitionBy(*keys))
    return full.withColumn("row_share", ratio(F.col("n"), row)).withColumn(
        "total_share", ratio(F.col("n"), whole))


def confusion_matrix(conf: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per run with the nested matrix, rows and columns in label order."""
    keys = list(keys)
    dense = confusion_dense(conf, keys)
    rows = dense.groupBy(*keys, "y_true").agg(
        F.array_sort(F.collect_list(F.struct("y_pred", "n"))).alias("_cells"))
    rows = rows.withColumn("_row", F.col("_cells")["n"])
    return rows.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("y_true", "_row"))).alias("_rows")).select(
        *keys, F.col("_rows")["y_true"].alias("labels"), F.col("_rows")["_row"].alias("confusion_matrix"))


def per_class(conf: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, class, tp, support, predicted, precision, recall, f1) over true and predicted labels."""
    zero = F.lit(0).cast("bigint")
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(zero)
    sides = F.array(
        F.struct(F.col("y_true").alias("class"), F.col("n").alias("support"),
                 zero.alias("predicted"), hit.alias("tp")),
        F.struct(F.col("y_pred").alias("class"), zero.alias("support"),
                 F.col("n").alias("predicted"), zero.alias("tp")),
    )
    counts = conf.select(*keys, F.inline(sides)).groupBy(*keys, "class").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"),
        F.sum("predicted").alias("predicted"))
    tp, sup, pred = F.col("tp"), F.col("support"), F.col("predicted")
    return (
        counts.withColumn("precision", ratio(tp, pred)).withColumn("recall", ratio(tp, sup))
        .withColumn("f1", ratio(2 * tp, sup + pred))
    )


def scalar_metrics(conf: DataFrame, keys: Sequence[str], binary: bool = False) -> DataFrame:
    """Accuracy, macro and weighted scores, MCC; for binary labels also FPR, DR and FNR."""
    c = per_class(conf, keys)
    tp, sup, pred = (F.col(x).cast("double") for x in ("tp", "support", "predicted"))
    total, hits = F.sum(sup), F.sum(tp)
    spread = (total * total - F.sum(pred * pred)) * (total * total - F.sum(sup * sup))
    # products of counts are exact in doubles only up to 2^53, so a spread of 0 is tested on counts
    one_class = (F.max(sup) == total) | (F.max(pred) == total)
    mcc = F.when(one_class, 0.0).otherwise(
        F.try_divide(hits * total - F.sum(pred * sup), F.sqrt(F.greatest(spread, F.lit(0.0)))))
    measures = [
        (hits / total).alias("accuracy"),
        F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("f1") * sup) / total).alias("f1_weighted"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        mcc.alias("mcc"),
    ]
    if binary:
        positive = F.col("class") == 1
        tp1 = F.sum(F.when(positive, tp).otherwise(0.0))
        sup1 = F.sum(F.when(positive, sup).otherwise(0.0))
        pred1 = F.sum(F.when(positive, pred).otherwise(0.0))
        square = F.count(F.lit(1)) == 2
        measures += [
            F.when(square, ratio(pred1 - tp1, total - sup1)).alias("false_positive_rate"),
            F.when(square, ratio(tp1, sup1)).alias("detection_rate"),
            F.when(square, ratio(sup1 - tp1, sup1)).alias("false_negative_rate"),
        ]
    return c.groupBy(*keys).agg(*measures)


def binary_counts(conf: DataFrame, keys: Sequence[str]) -> DataFrame:
    """tn, fp, fn, tp and their shares of all rows, per run of a 0/1 problem."""
    cell = lambda t, p: F.sum(F.when((F.col("y_true") == t) & (F.col("y_pred") == p), F.col("n"))
                              .otherwise(0)).cast("bigint")
    wide = conf.groupBy(*keys).agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"),
                                   cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))
    total = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    return wide.select(*keys, "tn", "fp", "fn", "tp", *[
        ratio(F.col(c), total).alias(f"{c}_share") for c in ("tn", "fp", "fn", "tp")])


def evaluate(preds: DataFrame, keys: Sequence[str], label_type: str = "binary",
             auc: bool = True) -> DataFrame:
    """The metric suite, one row per run. ``roc_auc`` is NULL without a ``probs`` column."""
    check_label_type(label_type)
    keys = list(keys)
    if label_type == "binary":
        return _evaluate_binary(preds, keys, auc and "probs" in preds.columns)
    return _evaluate_multiclass(preds, keys, auc and "probs" in preds.columns)


def _evaluate_multiclass(preds: DataFrame, keys: list[str], auc: bool) -> DataFrame:
    empty = [F.lit(None).cast("double").alias(m) for m in BINARY_RATES]
    if not auc:
        wide = scalar_metrics(confusion(preds, keys), keys).select("*", *empty)
        return wide.withColumn("roc_auc", F.lit(None).cast("double"))
    # one scan feeds both, and the long form of the probabilities is made in the packing task
    base = cut_lineage(curves.pack_scores(preds, keys, F.col("y_true"), F.col("probs"), ["y_true", "y_pred"]))
    area = mean_over_classes(curves.area(base, [*keys, "_class"], "_auc"), keys)
    conf = curves.counts(base, keys, ["y_true", "y_pred"])
    return join_null_safe(scalar_metrics(conf, keys).select("*", *empty), area, keys, "left")


def _evaluate_binary(preds: DataFrame, keys: list[str], auc: bool) -> DataFrame:
    if not auc:
        wide = scalar_metrics(confusion(preds, keys), keys, binary=True)
        return wide.withColumn("roc_auc", F.lit(None).cast("double"))
    # one scan feeds both the confusion counts and the ROC curve
    base = cut_lineage(curves.pack_scores(preds, keys, F.col("y_true"), F.array(F.get("probs", F.lit(1))), ["y_true", "y_pred"], first_class=1))
    conf = curves.counts(base, keys, ["y_true", "y_pred"])
    return join_null_safe(scalar_metrics(conf, keys, binary=True), curves.area(base, keys), keys, "left")


def per_class_f1_map(conf: DataFrame, keys: Sequence[str]) -> DataFrame:
    """class -> F1 as one map per run, keyed by the class itself."""
    return per_class(conf, keys).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct(F.col("class").cast("string").alias("class"), "f1")))).alias("per_class_f1"))


def classification_report(conf: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per-class rows plus accuracy, macro avg and weighted avg rows, as (keys, row, ...)."""
    keys = list(keys)
    c = per_class(conf, keys)
    classes = c.select(*keys, F.col("class").cast("string").alias("row"),
                       "precision", "recall", "f1", "support")
    sup = F.col("support")
    s = c.groupBy(*keys).agg(
        F.sum("support").alias("support"),
        (F.sum("tp") / F.sum(sup)).alias("accuracy"),
        *[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")],
        *[(F.sum(F.col(m) * sup) / F.sum(sup)).alias(f"weighted_{m}")
          for m in ("precision", "recall", "f1")])
    none = F.lit(None).cast("double")
    lines = F.array(
        F.struct(F.lit("accuracy").alias("row"), none.alias("precision"), none.alias("recall"),
                 F.col("accuracy").alias("f1"), sup),
        *[F.struct(F.lit(f"{a} avg").alias("row"), *[
            F.col(f"{a}_{m}").alias(m) for m in ("precision", "recall", "f1")], sup)
          for a in ("macro", "weighted")])
    return classes.unionByName(s.select(*keys, F.inline(lines)))


def utility_loss(base: Column, value: Column) -> tuple[Column, Column]:
    """(absolute loss to 4 places, loss in percent to 2 places); NULL if not defined."""
    known = value.isNotNull() & (base > 0)
    loss = base - value
    return (F.when(known, rnd(loss, 4)),
            F.when(known, rnd(F.lit(100.0) * loss / base, 2)))
