"""Raw labels to one class taxonomy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentinel.functions.cols import lookup
from sentinel.functions.storage import small_table
from sentinel.schema import BENIGN, CIC_LABELS, UNKNOWN, UNSW_LABELS


def binary_from_class(df: DataFrame) -> DataFrame:
    """0 for benign rows, 1 for everything else, Unknown included."""
    return df.withColumn(
        "label_binary", F.when(F.col("label_multiclass") == BENIGN, 0).otherwise(1).cast("tinyint"))


def map_cic_labels(df: DataFrame, raw: str = "label") -> DataFrame:
    if raw not in df.columns:
        raise KeyError(f"label column '{raw}' not found among {df.columns}")
    text = F.trim(F.coalesce(F.col(raw).cast("string"), F.lit("nan")))
    mapped = df.withColumn("label_raw", text).withColumn(
        "label_multiclass", lookup(CIC_LABELS, F.lower("label_raw"), F.lit(UNKNOWN)))
    mapped = binary_from_class(mapped)
    return mapped if raw in ("label_raw",) else mapped.drop(raw)


def map_unsw_labels(df: DataFrame, category: str = "attack_cat", label: str = "label") -> DataFrame:
    """A missing category is normal traffic; the binary label is the data set's own column."""
    text = F.trim(F.coalesce(F.col(category).cast("string"), F.lit("")))
    return (
        df.withColumn("label_raw", text)
        .withColumn("label_multiclass", lookup(UNSW_LABELS, F.lower("label_raw"), F.lit(UNKNOWN)))
        .withColumn("label_binary", F.col(label).cast("double").cast("tinyint"))
        .drop(category, label)
    )


def map_labels(df: DataFrame, dataset: str) -> DataFrame:
    if dataset == "cic_ids2018":
        return map_cic_labels(df)
    if dataset == "unsw_nb15":
        return map_unsw_labels(df)
    raise ValueError(f"no label map for data set '{dataset}'")


def unmapped_labels(df: DataFrame) -> DataFrame:
    """Raw labels that fell through to Unknown, with their row counts."""
    return (
        df.where(F.col("label_multiclass") == UNKNOWN)
        .groupBy("label_raw").agg(F.count(F.lit(1)).alias("n_rows"))
    )


def fit_encoder(df: DataFrame, label: str = "label_multiclass") -> DataFrame:
    """(label, code) with codes in sorted label order; as many rows as there are classes."""
    classes = df.select(F.col(label).cast("string").alias(label)).where(F.col(label).isNotNull()).distinct()
    order = Window.orderBy(label)  # one row per class
    return classes.select(label, (F.row_number().over(order) - 1).alias("code"))


def encode(df: DataFrame, encoder: DataFrame, label: str = "label_multiclass") -> DataFrame:
    """Add ``code``; a label the encoder has not seen raises when the row is evaluated."""
    joined = df.join(small_table(encoder), label, "left")
    unseen = F.raise_error(F.concat(F.lit("unseen label: "), F.coalesce(F.col(label), F.lit("null"))))
    return joined.withColumn("code", F.coalesce("code", unseen.cast("int")))
