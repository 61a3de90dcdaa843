"""Incremental ingest: the batch cleaning expressions over a file stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentinel.functions.storage import cut_lineage, list_dir
from sentinel.plans.preprocess import clean_rows
from sentinel.sources.raw import read_files

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def stream_files(spark: SparkSession, raw_dir: str, dataset: str, files_per_batch: int = 4) -> DataFrame:
    """Paths of raw CSV files as they arrive, ``files_per_batch`` new files per micro-batch; contents are not read."""
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("maxFilesPerTrigger", files_per_batch)
    return files.option("pathGlobFilter", "*.csv").load(f"{raw_dir.rstrip('/')}/{dataset}").select("path")


def ingest_available(spark: SparkSession, raw_dir: str, dataset: str, path: str, checkpoint: str, files_per_batch: int = 4) -> None:
    """Clean all files that have arrived since the last call and add them to the table at ``path``.

    A micro-batch reads its files by their own headers, so files with other columns may arrive at any time.
    A batch that is repeated after a failure replaces its own part of the table.
    """
    def clean_batch(batch: DataFrame, number: int) -> None:
        files = sorted(r["path"] for r in batch.collect())  # at most files_per_batch names
        if files:
            rows = clean_rows(read_files(batch.sparkSession, files, dataset), dataset)
            rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream = stream_files(spark, raw_dir, dataset, files_per_batch).writeStream.foreachBatch(clean_batch)
    stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


KEY, PREFIX = "_row_key", "_prefix"
PREFIX_DIGITS = 2


def content_key(df: DataFrame) -> Column:
    """md5 over the names and values of all columns that are not NULL: rows are equal if it is equal, also across tables of which one lacks a column
    that is NULL in the other. -0.0 counts as 0.0."""
    def text(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        c = c + F.lit(0.0).cast(field.dataType) if isinstance(field.dataType, (T.FloatType, T.DoubleType)) else c
        value = c.cast("string")
        return F.when(value.isNotNull(), F.concat(F.lit(f"{field.name}="), F.length(value).cast("string"), F.lit(":"), value))

    return F.md5(F.concat_ws(";", *[text(f) for f in sorted(df.schema.fields, key=lambda f: f.name)]))


def _seen_keys(spark: SparkSession, keys: str, before: int) -> DataFrame | None:
    """Keys of all earlier batches, of which some may hold no file. A batch that is repeated does not meet its own."""
    parts = [n for n in list_dir(spark, keys) if n.startswith("batch=") and int(n[6:]) < before]
    return spark.read.schema(f"key binary, {PREFIX} string").option("basePath", keys).parquet(*[f"{keys}/{p}" for p in parts]).drop("batch") if parts else None


def ingest_distinct(spark: SparkSession, raw_dir: str, dataset: str, path: str, checkpoint: str, files_per_batch: int = 4) -> None:
    """As :func:`ingest_available`, without exact duplicates: a row enters the table at ``path`` only if no earlier batch has held it.

    The keys of all rows lie beside the table at ``<path>_keys``, 16 bytes a row, by batch and by the first digits of the key. A batch looks
    its own keys up there (a small batch is broadcast and reads only the prefixes it holds) and drops what it finds. Table and keys of a batch are
    overwritten if the batch is repeated, and only keys of smaller batch numbers count, so a repeated batch gives the same rows.
    """
    keys = f"{path.rstrip('/')}_keys"

    def add_batch(batch: DataFrame, number: int) -> None:
        files, session = sorted(r["path"] for r in batch.collect()), batch.sparkSession  # at most files_per_batch names
        if not files:
            return
        rows = clean_rows(read_files(session, files, dataset), dataset)
        fresh = cut_lineage(rows.withColumn(KEY, content_key(rows)).dropDuplicates([KEY]).withColumn(PREFIX, F.substring(KEY, 1, PREFIX_DIGITS)))
        seen = _seen_keys(session, keys, number)
        if seen is not None:
            known = seen.join(fresh.select(F.unhex(KEY).alias("key"), PREFIX), ["key", PREFIX], "left_semi")
            fresh = cut_lineage(fresh.join(known.select(F.lower(F.hex("key")).alias(KEY)), KEY, "left_anti"))
        fresh.drop(KEY, PREFIX).write.mode("overwrite").parquet(f"{path}/batch={number}")
        slim = fresh.select(F.unhex(KEY).alias("key"), PREFIX).repartition(PREFIX)
        slim.write.mode("overwrite").partitionBy(PREFIX).parquet(f"{keys}/batch={number}")

    stream = stream_files(spark, raw_dir, dataset, files_per_batch).writeStream.foreachBatch(add_batch)
    stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_ingested(spark: SparkSession, path: str) -> DataFrame:
    """The table of :func:`ingest_available`; columns that a batch lacks are NULL."""
    return spark.read.option("mergeSchema", True).parquet(path).drop("batch")


def drop_recent_duplicates(rows: DataFrame, columns: list[str], event_time: str, delay: str) -> DataFrame:
    """Duplicates within ``delay`` of event time; state older than that is forgotten."""
    return rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(columns)


def run_available(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything that has arrived, append it to a Parquet table, and stop."""
    query = (
        rows.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
