"""Rendezvous hashing of record keys over weighted shards.

Every shard draws a keyed exponential number, divided by its weight, for a record key; the smallest draw wins. A
new shard only takes records for which its own draw is the smallest, so no record moves between old shards. Equal
keys always share a shard, however many rows they have.

Slots number the rows of a shard from 0 without gaps: rows are dealt into parts by a hash, parts are counted, and a
row's slot is its place in its part plus the rows of earlier parts. No window spans a shard.

Defined cases: a null key is the text "null". A null text has size 1 and the checksum of no bytes. Rows that are
equal in key, size and checksum are interchangeable and take consecutive slots. Other columns are ignored. An
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sentinel.functions.storage import cut_lineage
from sentinel.llm.common import numbered_copies

PART_ROWS = 20_000


def shard_of(key: Column | str, weights: list[float]) -> Column:
    """Number of the winning shard; a shard's draws depend on the key, its own number and its own weight only."""
    k = F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit("null"))
    draws = []
    for shard, weight in enumerate(weights):
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(shard), k), 12).cast("double")
        draws.append(F.struct((-F.ln((bits + 0.5) / float(1 << 52)) / weight).alias("draw"), F.lit(shard).alias("shard")))
    return (F.array_min(F.array(*draws)) if len(draws) > 1 else draws[0])["shard"].cast("int")


def with_slots(rows: DataFrame, total: int, keys: list[str], part_rows: int = PART_ROWS) -> DataFrame:
    """Adds ``slot`` to rows that have a shard; ``keys`` tell all rows apart."""
    shards = max(total // part_rows, 1)
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(shards)))
    before = F.sum("_n").over(W.partitionBy("shard").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    sizes = dealt.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("shard", "_part", F.coalesce(before, F.lit(0)).alias("_offset"))
    place = F.row_number().over(W.partitionBy("shard", "_part").orderBy(*keys))
    placed = dealt.withColumn("_place", place).join(offsets, ["shard", "_part"])
    return placed.withColumn("slot", (F.col("_place") - 1 + F.col("_offset")).cast("long")).drop("_part", "_place", "_offset")


def rendezvous(docs: DataFrame, weights: list[float], grown_weight: float = 1.0, key: str = "doc_id") -> DataFrame:
    """key, size, text_crc32, law, shard, slot and grown_shard (with one more shard) for every row of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(key, (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    keys = [key, "size", "text_crc32", "copy"]
    rows = cut_lineage(numbered_copies(rows, keys[:-1])
                       .withColumn("shard", shard_of(key, weights))
                       .withColumn("grown_shard", shard_of(key, [*weights, grown_weight])))
    placed = with_slots(rows, rows.count(), keys)
    return placed.select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
