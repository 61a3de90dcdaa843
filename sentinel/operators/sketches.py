"""Mergeable quantile sketches of tables that grow: one sketch per batch and feature, stored and merged, so old rows are not read again.

The sketches are KLL sketches of Spark. The rank of an answer is off by a share of the rows that depends on ``k`` only; :func:`rank_error`
measures it against the rows, and :mod:`sentinel.operators.ranking` gives exact quantiles where they are needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinel.functions.storage import list_dir
from sentinel.operators.ranking import to_long

SKETCH_K = 400  # a rank is within 0.7 % of the rows with 99 % confidence


def batch_sketches(df: DataFrame, features: Sequence[str], k: int = SKETCH_K) -> DataFrame:
    """(feature, sketch) of one batch, from one scan; NULL and NaN are left out."""
    long = to_long(df, features).where(F.col("value").isNotNull() & ~F.isnan("value"))
    return long.groupBy("feature").agg(F.kll_sketch_agg_double("value", F.lit(k)).alias("sketch"))


def add_batch(df: DataFrame, features: Sequence[str], root: str, batch: str | int, k: int = SKETCH_K) -> None:
    """Store the sketches of a batch; a repeated batch replaces its own."""
    batch_sketches(df, features, k).coalesce(1).write.mode("overwrite").parquet(f"{root.rstrip('/')}/batch={batch}")


def merged(spark: SparkSession, root: str, k: int = SKETCH_K) -> DataFrame:
    """(feature, sketch) over all batches stored at ``root``."""
    if not any(n.startswith("batch=") for n in list_dir(spark, root)):
        raise FileNotFoundError(f"no sketches at {root}")
    return spark.read.parquet(root).groupBy("feature").agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def quantiles(sketches: DataFrame, probs: Sequence[float]) -> DataFrame:
    """(feature, prob, n, quantile) in the form of the exact operator; the quantile is a value of the table."""
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    pairs = F.arrays_zip(wanted.alias("prob"), F.kll_sketch_get_quantile_double("sketch", wanted).alias("quantile"))
    each = sketches.select("feature", F.kll_sketch_get_n_double("sketch").alias("n"), F.explode(pairs).alias("_at"))
    return each.select("feature", F.col("_at")["prob"].alias("prob"), "n", F.col("_at")["quantile"].alias("quantile"))


def rank_error(df: DataFrame, features: Sequence[str], found: DataFrame) -> DataFrame:
    """(feature, prob, n, quantile, rank_error): how far ``prob`` lies outside the ranks that the quantile has in the rows, as a share of them."""
    long = to_long(df, features).where(F.col("value").isNotNull() & ~F.isnan("value"))
    asked = F.broadcast(found.select("feature", "prob", "quantile"))  # features times probabilities
    counts = long.join(asked, "feature").groupBy("feature", "prob", "quantile").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") < F.col("quantile")).alias("_below"), F.count_if(F.col("value") <= F.col("quantile")).alias("_upto"))
    low, high = F.col("_below") / F.col("n"), F.col("_upto") / F.col("n")
    return counts.select("feature", "prob", "n", "quantile", F.greatest(low - F.col("prob"), F.col("prob") - high, F.lit(0.0)).alias("rank_error"))
