"""Result store: runs, attacks and model parameters as versioned Parquet tables.

A save writes a complete new version next to the old ones and then commits it; readers take the last commit, so a
lost job never leaves a half-written store. A save that finds another one committed since it read the store merges again on top
of that, so savers at the same time lose no row of each other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentinel.functions.storage import list_dir, path_exists, remove_dir
from sentinel.schema import DP_MODELS, MODEL_ORDER
from sentinel.sources.commits import CommitLog

RUN_KEY = ("dataset", "label_type", "model_name", "epsilon", "split")
ATTACK_KEY = ("dataset", "label_type", "target_model", "epsilon")


def upsert(existing: DataFrame, new: DataFrame, key: Sequence[str] = RUN_KEY,
           version: str = "version") -> DataFrame:
    """Union keeping the row with the highest version per key; NULL epsilons are equal.

    The newest row is found by a partial aggregation, so repeated saves of one key are not
    gathered in one task.
    """
    both = existing.unionByName(new, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in key and c != version]
    newest = F.max_by(F.struct(*rest), F.col(version)).alias("_row")
    return both.groupBy(*key).agg(newest, F.max(version).alias(version)).select(
        *[F.col(c) if c in key or c == version else F.col(f"_row.{c}").alias(c) for c in both.columns])


def combine(*families: DataFrame, key: Sequence[str] = RUN_KEY) -> DataFrame:
    """All model families in one table, newest row per key."""
    out = families[0].limit(0)
    for f in families:
        out = out.unionByName(f, allowMissingColumns=True)
    return upsert(families[0].limit(0), out, key)


def pending(runs: DataFrame, done: DataFrame, key: Sequence[tuple[str, str]]) -> DataFrame:
    """Runs whose key is not among the finished ones; ``key`` pairs (runs column, done column)."""
    r, d = runs.alias("r"), done.alias("d")
    same = [F.col(f"r.{a}").eqNullSafe(F.col(f"d.{b}")) for a, b in key]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return r.join(d, cond, "left_anti")


def load(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The store as of its last commit, or an empty table with the schema."""
    log = CommitLog(spark, root)
    _, entry = log.last()
    return spark.createDataFrame([], schema) if entry is None else spark.read.schema(schema).parquet(log.folder(entry))


def save(new: DataFrame, root: str, schema: T.StructType, key: Sequence[str] = RUN_KEY, attempts: int = 20) -> int:
    """Upsert into the store; returns the new version number."""
    spark, log = new.sparkSession, CommitLog(new.sparkSession, root)
    for _ in range(attempts):
        seen, entry = log.last()
        taken = [int(n[2:].split("-")[0]) for n in list_dir(spark, root) if n.startswith("v=")]
        version = max(taken, default=0) + 1
        stamped = new.withColumn("version", F.lit(version).cast("bigint"))
        old = stamped.limit(0) if entry is None else spark.read.schema(schema).parquet(log.folder(entry))
        merged = upsert(old, stamped, key)
        present = set(merged.columns)
        folder = log.new_folder(f"v={version}")
        merged.select(*[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema]).write.parquet(f"{root.rstrip('/')}/{folder}")
        if log.append(seen, {"folder": folder, "version": version}):
            return version
        remove_dir(spark, f"{root.rstrip('/')}/{folder}")
    raise RuntimeError(f"{root} was saved by others {attempts} times while this save ran")


def run_rank(model: str = "model_name") -> Column:
    """Position of a model family: non-private ones first."""
    out = F.lit(len(MODEL_ORDER))
    for i, name in reversed(list(enumerate(MODEL_ORDER))):
        out = F.when(F.col(model) == name, i).otherwise(out)
    return out


def expected_runs(spark: SparkSession, epsilons: Sequence[float]) -> DataFrame:
    """(model_name, epsilon): the three baselines and every private model at every budget."""
    rows = [(m, None) for m in MODEL_ORDER if m not in DP_MODELS]
    rows += [(m, float(e)) for m in DP_MODELS for e in epsilons]
    return spark.createDataFrame(rows, "model_name string, epsilon double")


def pipeline_status(runs: DataFrame, epsilons: Sequence[float]) -> DataFrame:
    """(model_name, n_expected, n_trained, complete) for the run grid against the stored runs."""
    grid = F.broadcast(expected_runs(runs.sparkSession, epsilons))
    done = runs.select("model_name", "epsilon").distinct().withColumn("_done", F.lit(True))
    g, d = grid.alias("g"), done.alias("d")
    joined = g.join(d, (F.col("g.model_name") == F.col("d.model_name"))
                    & F.col("g.epsilon").eqNullSafe(F.col("d.epsilon")), "left")
    return joined.groupBy(F.col("g.model_name").alias("model_name")).agg(
        F.count(F.lit(1)).alias("n_expected"),
        F.count("_done").alias("n_trained"),
        (F.count("_done") == F.count(F.lit(1))).alias("complete"))


def list_models(models: DataFrame) -> DataFrame:
    """Baselines first, then private models by ascending epsilon, with the stored size."""
    return models.orderBy(run_rank(), F.col("epsilon").asc_nulls_first())


PARAMETER_SCHEMA = T.StructType([
    T.StructField("dataset", T.StringType()),
    T.StructField("label_type", T.StringType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("epsilon", T.DoubleType()),
    T.StructField("names", T.ArrayType(T.StringType())),
    T.StructField("values", T.ArrayType(T.DoubleType())),
    T.StructField("version", T.LongType()),
])
PARAMETER_KEY = ("dataset", "label_type", "model_name", "epsilon")


def save_parameters(models: DataFrame, root: str) -> int:
    """Add models (dataset, label_type, model_name, epsilon, names, values) to the store; equal keys are replaced."""
    return save(models, root, PARAMETER_SCHEMA, PARAMETER_KEY)


def stored_models(spark: SparkSession, root: str) -> DataFrame:
    """Listing of the store with the size of each parameter vector."""
    models = load(spark, root, PARAMETER_SCHEMA).where("model_name <> 'scaler'")
    return list_models(models.select(*PARAMETER_KEY, F.size("values").cast("long").alias("n_values"), (F.size("values") * 8 / 1024).alias("size_kb")))


def load_parameters(spark: SparkSession, root: str, dataset: str, label_type: str, model_name: str,
                    epsilon: float | None = None) -> list[float]:
    """Stored parameter vector of one model (a scaler is a model named 'scaler')."""
    if model_name in DP_MODELS and epsilon is None:
        raise ValueError(f"{model_name} needs an epsilon")
    if not path_exists(spark, root):
        raise FileNotFoundError(f"no model store at {root}")
    row = load(spark, root, PARAMETER_SCHEMA).where(
        (F.col("dataset") == dataset) & (F.col("label_type") == label_type)
        & (F.col("model_name") == model_name) & F.col("epsilon").eqNullSafe(F.lit(epsilon).cast("double"))
    ).first()
    if row is None:
        raise FileNotFoundError(f"{model_name} (epsilon={epsilon}) is not trained for {dataset}")
    return list(row["values"])
