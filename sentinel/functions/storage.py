"""Where intermediate tables live, and checked-size small tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a fresh local one only for local masters."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):  # local-cluster has executors of its own
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        named = tempfile.mkdtemp(prefix="sentinel-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write once to reliable storage; later jobs read that copy, also after executors are lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_table(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """Evaluate a table expected to be tiny and return it with a broadcast hint.

    At most ``max_rows`` + 1 rows are fetched. A larger table comes back as the plain lazy
    DataFrame, so that the join shuffles instead.
    """
    fetched = df.limit(max_rows + 1).toArrow()
    if fetched.num_rows > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(fetched, schema=df.schema))


def use_all_cores(df: DataFrame) -> DataFrame:
    """Spread a scanned or checkpointed table with fewer partitions than the cluster has cores.

    Tables with enough splits, as any large one, are returned as they are, without a shuffle. Call
    it on scans only: counting the partitions of a plan with shuffles would run them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def training_table(df: DataFrame) -> DataFrame:
    """Rows for repeated passes: written once to reliable storage, in enough parts for all cores."""
    stored = cut_lineage(df)
    spread = use_all_cores(stored)
    return stored if spread is stored else cut_lineage(spread)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def list_dir(spark: SparkSession, path: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def first_line(spark: SparkSession, path: str, encoding: str) -> str | None:
    """First line of a text file without reading the rest; None if the file is empty."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, encoding)).readLine()
    finally:
        stream.close()


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder of temporary tables that this job wrote."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def file_states(spark: SparkSession, paths: list[str]) -> list[tuple[str, int, int]]:
    """(name, bytes, time of change) of files."""
    jvm, conf, out = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        status = p.getFileSystem(conf).getFileStatus(p)
        out.append((p.getName(), status.getLen(), status.getModificationTime()))
    return out


def read_text(spark: SparkSession, path: str) -> str:
    """The whole of a small text file."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        return spark.sparkContext._jvm.java.lang.String(stream.readAllBytes(), "UTF-8")
    finally:
        stream.close()


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file with ``text``; False if it exists already. Of several writers exactly one succeeds.

    HDFS and stores with conditional puts refuse a second create. The local file system does not, so there a finished
    file is linked to the name, which fails if the name is taken.
    """
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p.getParent())
    if fs.getUri().getScheme() == "file":
        target = jvm.org.apache.hadoop.fs.Path.getPathWithoutSchemeAndAuthority(p).toString()
        draft = f"{os.path.dirname(target)}/.{uuid.uuid4().hex}"
        with open(draft, "x", encoding="utf-8") as out:
            out.write(text)
        try:
            os.link(draft, target)
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True
    try:
        stream = fs.create(p, False)
    except Exception as refused:  # the JVM's error, whichever class the store uses
        if fs.exists(p):
            return False
        raise refused
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return True
