"""Processed tables and working subsets as Parquet.

A published table is a folder of its own that the last commit names, with a fingerprint of what it was made from: a stage runs again when
its inputs or settings have changed, and a stage that fails leaves the table as it was.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinel.functions.storage import path_exists
from sentinel.sources import raw
from sentinel.sources.commits import CommitLog


def is_complete(spark: SparkSession, path: str) -> bool:
    return CommitLog(spark, path).last()[1] is not None or path_exists(spark, f"{path.rstrip('/')}/_SUCCESS")


def fingerprint(*parts: object) -> str:
    """Of inputs and settings, by their JSON form."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def published(spark: SparkSession, path: str) -> dict | None:
    """The entry of a published table: folder, fingerprint and what the stage added."""
    return CommitLog(spark, path).last()[1]


def publish(df: DataFrame, path: str, partitions: Sequence[str] = (), of: str = "", **more: object) -> None:
    """Write a table and make it the current one at ``path``. Older ones stay until :meth:`CommitLog.vacuum`."""
    log = CommitLog(df.sparkSession, path)
    folder = log.new_folder("data")
    df.write.option("compression", "snappy").partitionBy(*partitions).parquet(f"{path.rstrip('/')}/{folder}")
    while not log.append(log.last()[0], {"folder": folder, "fingerprint": of, **more}):
        pass  # another writer came first; the later commit stands


def build_once(spark: SparkSession, path: str, build: Callable[[], None], force: bool = False, of: str | None = None) -> bool:
    """Run a stage unless its output is complete and, with ``of``, made from the same inputs and settings; returns whether it ran."""
    entry = published(spark, path)
    same = of is None or (entry is not None and entry.get("fingerprint") == of)
    if is_complete(spark, path) and same and not force:
        return False
    build()
    return True


def write_processed(df: DataFrame, path: str) -> None:
    (df.write.mode("overwrite").option("compression", "snappy")
     .partitionBy("dataset_source").parquet(path))


def write_subset(df: DataFrame, path: str) -> None:
    if "split" not in df.columns:
        raise ValueError("the subset has no 'split' column; assign the split first")
    (df.write.mode("overwrite").option("compression", "snappy")
     .partitionBy("dataset_source", "split").parquet(path))


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    if not path_exists(spark, path):
        raise FileNotFoundError(f"{path} does not exist; run the stage that writes it")
    entry = published(spark, path)
    df = spark.read.parquet(path if entry is None else f"{path.rstrip('/')}/{entry['folder']}")
    return df.select(*columns) if columns else df


def split_counts(subset: DataFrame) -> DataFrame:
    return subset.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))


def union_sources(*tables: DataFrame) -> DataFrame:
    """One table over several data sets; columns one of them lacks become NULL."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def export_csv(report: DataFrame, path: str) -> None:
    """A report table as one CSV file with header."""
    report.coalesce(1).write.mode("overwrite").option("header", True).option(
        "encoding", "UTF-8").csv(path)


def stage_status(spark: SparkSession, raw_dir: str, out_dir: str, dataset: str) -> DataFrame:
    """(stage, complete, n_rows) of a data set: raw files, processed table, subset, results. A missing stage has 0 rows."""
    out = out_dir.rstrip("/")
    paths = {"processed": f"{out}/processed/{dataset}", "subset": f"{out}/subsets/{dataset}", "results": f"{out}/results/{dataset}"}
    done = {stage: is_complete(spark, path) for stage, path in paths.items()}
    has_raw = path_exists(spark, f"{raw_dir.rstrip('/')}/{dataset}")
    parts = [raw.read_raw(spark, raw_dir, dataset).select(F.lit("raw").alias("stage"))] if has_raw else []
    parts += [read_table(spark, paths[stage]).select(F.lit(stage).alias("stage")) for stage, complete in done.items() if complete]
    known = spark.createDataFrame([("raw", has_raw), *done.items()], "stage string, complete boolean")
    none = spark.createDataFrame([], "stage string")
    counts = reduce(DataFrame.union, parts, none).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))
    return known.join(counts, "stage", "left").select("stage", "complete", F.coalesce("n", F.lit(0)).alias("n_rows"))
