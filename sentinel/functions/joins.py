"""Joins and repetitions that need care: keys with NULLs, and very many copies of one row."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COPY_CHUNK = 10_000


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys are equal to each other; the columns of ``left``, then the others of ``right``."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def explode_copies(df: DataFrame, copies: str, name: str = "copy") -> DataFrame:
    """Each row ``copies`` times, numbered from 1 in ``name``; no array is longer than a chunk or the number of chunks."""
    chunks = df.where(F.col(copies) > 0).withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(copies) - 1) / COPY_CHUNK))))
    first = F.col("_chunk") * COPY_CHUNK
    return chunks.withColumn(name, F.explode(F.sequence(first + 1, F.least(F.col(copies).cast("long"), first + COPY_CHUNK)))).drop("_chunk")
