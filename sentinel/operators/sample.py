"""Stratified subset, train/val/test split, class weights, weighted draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentinel.functions.joins import explode_copies, join_null_safe
from sentinel.functions.rand import uniform
from sentinel.functions.storage import small_table
from sentinel.operators.ranking import mark_smallest


def round_half_up(col: Column) -> Column:
    return F.floor(col + F.lit(0.5))


def stratified_subset(df: DataFrame, n: int, key: str, seed: int = 42,
                      stratum: str = "label_multiclass") -> DataFrame:
    """floor(n * class share) rows per class without replacement; the whole table if n covers it."""
    total = df.count()
    if n >= total:
        return df
    drawn = df.withColumn("_draw", uniform(seed, "subset", key))
    quota = lambda rows: F.floor(rows.cast("double") / F.lit(float(total)) * F.lit(float(n)))
    return mark_smallest(drawn, [stratum], "_draw", key, {"_taken": quota}).where("_taken").drop(
        "_draw", "_taken")


def shuffle_rows(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Rows in a repeatable random order, for consumers that depend on the physical order."""
    return df.orderBy(uniform(seed, "shuffle", key), key)


def add_split(df: DataFrame, key: str, test_size: float = 0.2, val_size: float | None = None,
              seed: int = 42, stratum: str = "label_multiclass") -> DataFrame:
    """Add ``split`` in {train, val, test}, exact per class and independent of partitioning."""
    val_size = test_size if val_size is None else val_size
    if not (0 < test_size and 0 < val_size and test_size + val_size < 1):
        raise ValueError("test_size and val_size must be positive and leave rows for training")
    n_test = lambda n: round_half_up(n * F.lit(test_size))
    n_val = lambda n: round_half_up((n - n_test(n)) * F.lit(val_size / (1.0 - test_size)))
    drawn = df.withColumn("_draw", uniform(seed, "split", key))
    marked = mark_smallest(drawn, [stratum], "_draw", key, {
        "_test": n_test, "_held": lambda n: n_test(n) + n_val(n)})
    split = F.when(F.col("_test"), "test").when(F.col("_held"), "val").otherwise("train")
    return marked.withColumn("split", split).drop("_draw", "_test", "_held")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n_rows, weight) with weight = n / (K * n_class); one row per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"))
    classes = Window.partitionBy(F.lit(0))  # over one row per class
    n, k = F.sum("n_rows").over(classes), F.count(F.lit(1)).over(classes)
    return counts.select(label, "n_rows", (n / (k * F.col("n_rows")).cast("double")).alias("weight"))


def add_class_weight(df: DataFrame, label: str) -> DataFrame:
    return join_null_safe(df, small_table(class_weights(df, label).select(label, "weight")), [label])


def resample_balanced(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """Rows with copies, all classes equally often: a row of weight w appears floor(w) or floor(w) + 1 times, w on average.

    The weight is the balanced class weight, so the expected size is that of the table. One keyed uniform number per
    row decides about the fraction, so the class sizes vary less than with independent draws, at any imbalance. NULL is a class.
    """
    drawn = add_class_weight(df, label).withColumn("_copies", F.floor(F.col("weight") + uniform(seed, "resample", key)))
    return explode_copies(drawn, "_copies").drop("_copies")
