"""Cleaning of raw flow rows: casts, missing values, duplicates, imputation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentinel.functions.cols import feature_columns
from sentinel.operators.ranking import exact_quantiles, to_long


def inf_to_null(col: Column) -> Column:
    """Infinite and NaN become NULL."""
    c = col.cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(col)


def to_float(col: Column, is_text: bool = True) -> Column:
    """Float32 or NULL; text that is no number gives NULL."""
    number = F.trim(col).try_cast("float") if is_text else col.cast("float")
    return inf_to_null(number)


def coerce_features(df: DataFrame) -> DataFrame:
    """Every non-metadata column to float32, with unparsable and infinite values as NULL."""
    features = set(feature_columns(df.columns))
    text = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    return df.select(*[
        to_float(F.col(c), c in text).alias(c) if c in features else F.col(c) for c in df.columns
    ])


def add_source(df: DataFrame, dataset: str) -> DataFrame:
    return df.withColumn("dataset_source", F.lit(dataset))


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Exact duplicates over all columns; copies collapse on the map side before the shuffle."""
    return df.dropDuplicates()


def null_fractions(df: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """(feature, null_fraction) from one aggregation over all features."""
    features = feature_columns(df.columns) if features is None else list(features)
    if not features:
        return df.sparkSession.createDataFrame([], "feature string, null_fraction double")
    one = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in features])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("null_fraction")) for c in features])))


def drop_sparse_columns(df: DataFrame, threshold: float = 0.6) -> tuple[DataFrame, list[str]]:
    """Drop features whose missing share is strictly above the threshold; metadata is exempt."""
    found = null_fractions(df).where(F.col("null_fraction") > threshold).collect()
    gone = {r["feature"] for r in found}
    dropped = [c for c in df.columns if c in gone]
    return df.drop(*dropped), dropped


def numeric_fill_values(df: DataFrame, features: Sequence[str], strategy: str = "median") -> DataFrame:
    """(feature, fill_value): exact median or mean of the non-missing values."""
    long = to_long(df, features)
    if strategy == "median":
        return exact_quantiles(long, [0.5]).select("feature", F.col("quantile").alias("fill_value"))
    if strategy == "mean":
        return (long.where(F.col("value").isNotNull() & ~F.isnan("value"))
                .groupBy("feature").agg(F.avg("value").alias("fill_value")))
    raise ValueError(f"strategy must be 'median' or 'mean', got '{strategy}'")


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, fill_value): most frequent value, the smallest one on ties."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value"))
                      for c in columns])
    counts = (
        df.select(F.inline(pairs)).where("value IS NOT NULL")
        .groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col("value").alias("value")))
    return counts.groupBy("feature").agg(best["value"].alias("fill_value"))


def fill(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Replace NULL by the given value per column, keeping each column's type."""
    types = {f.name: f.dataType for f in df.schema}
    return df.select(*[
        F.coalesce(F.col(c), F.lit(values[c]).cast(types[c])).alias(c)
        if values.get(c) is not None else F.col(c) for c in df.columns
    ])


def impute(df: DataFrame, strategy: str = "median", columns: Sequence[str] | None = None) -> DataFrame:
    """Numeric features by median or mean, text features by mode.

    ``columns`` names the features with missing values, if that is known already.
    """
    if columns is None:
        known = null_fractions(df).where("null_fraction > 0").collect()
        columns = [r["feature"] for r in known]
    features = [c for c in feature_columns(df.columns) if c in set(columns)]
    kinds = {f.name: f.dataType for f in df.schema}
    numeric = [c for c in features if isinstance(kinds[c], T.NumericType)]
    text = [c for c in features if isinstance(kinds[c], T.StringType)]
    values: dict[str, object] = {}
    if numeric:
        values.update({r["feature"]: r["fill_value"]
                       for r in numeric_fill_values(df, numeric, strategy).collect()})
    if text:
        values.update({r["feature"]: r["fill_value"] for r in modes(df, text).collect()})
    return fill(df, values)
