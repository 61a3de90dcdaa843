"""Published tables that are bucketed by key, so that joins on the key need no shuffle.

A table is shuffled once, when it is written: one sorted file per bucket. Tables with the same keys and number of buckets then join
bucket by bucket, however often. As with other published tables a folder of its own is written first and a commit names it, together with
schema, keys and number of buckets; any later session can therefore open it again. Keys should be of many values: a bucket holds all rows of its keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from sentinel.functions.storage import remove_dir
from sentinel.sources.commits import CommitLog


def _name(folder: str) -> str:
    return f"bucketed_{hashlib.sha256(folder.encode()).hexdigest()[:24]}"


def _define(spark: SparkSession, folder: str, entry: dict) -> str:
    """Name of the catalog's table over a folder; it is defined in this session if it is not yet."""
    keys = ", ".join(f"`{k}`" for k in entry["keys"])
    place = folder.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {_name(folder)} ({entry['columns']}) USING parquet "
              f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {entry['buckets']} BUCKETS LOCATION '{place}'")
    return _name(folder)


def write_bucketed(df: DataFrame, path: str, keys: Sequence[str], buckets: int | None = None) -> DataFrame:
    """Publish ``df`` at ``path`` in buckets of ``keys`` (as many as shuffle partitions, if not given) and return the stored table."""
    spark, log = df.sparkSession, CommitLog(df.sparkSession, path)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions")) if buckets is None else buckets
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    entry = {"folder": log.new_folder("buckets"), "keys": list(keys), "buckets": buckets, "columns": columns}
    name = _define(spark, log.folder(entry), entry)
    # The same hash decides the task and the bucket, so every task writes one file.
    df.repartition(buckets, *keys).write.insertInto(name)
    while not log.append(log.last()[0], entry):
        pass  # another writer came first; the later commit stands
    return spark.table(name)


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """The current table at ``path``."""
    log = CommitLog(spark, path)
    entry = log.last()[1]
    if entry is None:
        raise FileNotFoundError(f"no bucketed table at {path}")
    return spark.table(_define(spark, log.folder(entry), entry))


def drop_bucketed(spark: SparkSession, path: str) -> None:
    """Delete all versions of the table at ``path`` and their names in the catalog."""
    log = CommitLog(spark, path)
    for number in log.numbers():
        spark.sql(f"DROP TABLE IF EXISTS {_name(log.folder(log.read(number)))}")
    remove_dir(spark, path)
