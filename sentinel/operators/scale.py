"""Standardisation, norm and bound estimation, clipping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentinel.functions.cols import l2_norm
from sentinel.operators.ranking import exact_quantiles, to_long, vector_to_long


def fit_scaler(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, mean, scale): population deviation, 1 where it is 0. One pass, one row per feature."""
    one = train.agg(*[
        F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("sd")).alias(c) for c in features])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c)["mean"].alias("mean"),
                 F.when(F.col(c)["sd"] == 0, 1.0).otherwise(F.col(c)["sd"]).alias("scale"))
        for c in features])))


def apply_scaler(df: DataFrame, scaler: DataFrame, features: Sequence[str]) -> DataFrame:
    """Scaled features in place; the scaler is one row per column and becomes literals."""
    fitted = {r["feature"]: (r["mean"], r["scale"]) for r in scaler.collect()}
    return df.select(*[
        ((F.col(c) - F.lit(fitted[c][0])) / F.lit(fitted[c][1])).alias(c) if c in features else F.col(c)
        for c in df.columns])


def assemble(df: DataFrame, features: Sequence[str], name: str = "features") -> DataFrame:
    return df.withColumn(name, F.array(*[F.col(c).cast("double") for c in features]))


def norm_bound(df: DataFrame, features: str = "features", buffer: float = 0.05) -> DataFrame:
    """(n, median_norm, norm_p99, bound): 99th percentile of the row norms plus a buffer."""
    norms = df.select(F.lit("norm").alias("feature"), l2_norm(features).alias("value"))
    q = exact_quantiles(norms, [0.5, 0.99])
    at = lambda p: F.max(F.when(F.col("prob") == p, F.col("quantile")))
    return q.agg(F.max("n").alias("n"), at(0.5).alias("median_norm"), at(0.99).alias("norm_p99"),
                 (at(0.99) * (1.0 + buffer)).alias("bound"))


def feature_bounds(df: DataFrame, features: str | Sequence[str], percentile: float = 99.0,
                   buffer: float = 0.10) -> DataFrame:
    """(feature, lower, upper): outer percentiles, widened by a share of their range."""
    long = vector_to_long(df, features) if isinstance(features, str) else to_long(df, features)
    lo_p, hi_p = (100.0 - percentile) / 100.0, percentile / 100.0
    q = exact_quantiles(long, [lo_p, hi_p])
    lo = F.max(F.when(F.col("prob") == lo_p, F.col("quantile")))
    hi = F.max(F.when(F.col("prob") == hi_p, F.col("quantile")))
    return q.groupBy("feature").agg(
        (lo - (hi - lo) * buffer).alias("lower"), (hi + (hi - lo) * buffer).alias("upper"))


def clip_to_norm(features: Column, bound: float) -> Column:
    """x * min(1, bound / |x|)."""
    norm = l2_norm(features)
    factor = F.when(norm > bound, F.lit(bound) / norm).otherwise(F.lit(1.0))
    return F.transform(features, lambda v: v.cast("double") * factor)


def clip_to_bounds(features: Column, lower: Sequence[float], upper: Sequence[float]) -> Column:
    lo = F.array(*[F.lit(float(v)) for v in lower])
    hi = F.array(*[F.lit(float(v)) for v in upper])
    return F.transform(
        features,
        lambda v, i: F.greatest(F.get(lo, i), F.least(F.get(hi, i), v.cast("double"))))
