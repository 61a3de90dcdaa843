"""From raw documents to packed training sequences: five stages, each written as Parquet and read again.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the
last return the columns of documents. The dedup stage keeps one row of those equal in doc_id and text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinel.functions.storage import remove_dir, shared_dir
from sentinel.llm import minhash, mixing, packing, quality_rules, secret_scan
from sentinel.llm.common import row_key, unpacked, whole_row


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the trees go."""
    trees = quality_rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.keep(docs, trees)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays. Near means a similarity of 0.8 or more; the bands miss 7e-6 of the pairs at 0.8.

    Texts are told apart by doc_id and text, so different texts under one doc_id are judged each on their own. The one that stays has the smallest
    doc_id of its group; rows without one come last.
    """
    number = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), row_key("doc_id", "text").alias("key"))
    kept = minhash.near_duplicates(docs.select(number.alias("doc_id"), "text"), percent=80, bands=30).where("kept").select(F.col("doc_id.key").alias("_key")).distinct()
    rows = docs.select(row_key("doc_id", "text").alias("_key"), whole_row(docs))
    once = rows.join(kept, "_key").groupBy("_key").agg(F.first("_doc").alias("_doc"))
    return once.select(*unpacked(once, docs.columns))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; widely copied examples stay."""
    return secret_scan.redact(docs, F.col("source"), F.concat_ws("/", "source", "lang"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in bins of permitted lengths."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", keep_quality),
    ("minhash_dedup", drop_near_duplicates),
    ("secret_scans", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Boosted trees and random draws have no SQL; the tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; stage tables go to a folder of their own below the shared folder, and each is deleted once the next is complete."""
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove_dir(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
