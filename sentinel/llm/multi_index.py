"""Nearest neighbours by cosine with an inverted multi-index.

Unit vectors are cut into two halves, each quantised with its own k-means codebook. A cell is a pair of
centroids, and every vector is an entry of one cell. A query visits cells in the order of the summed squared
distances of its halves, taken from a heap, until the visited cells hold a wanted share of all entries. The
entries of visited cells are scored exactly, in double precision, on the original vectors.

Codebooks are fitted on a bounded sample (``sample_rows``, smallest keyed hashes). The wanted share is
measured on the same sample: the smallest that gives ``recall`` against brute force there. Clustered data
need little of the index, isotropic data much of it. Every row is indexed.

Equal vectors are one entry with their k+1 smallest ids, which is all that any answer of k can use, so a
vector that occurs a million times costs one row. Equal query vectors are searched once.

Vectors of different lengths have no cosine; each length has an index of its own and its queries are answered from it.

Defined cases: vectors that are null, empty, all zero, or hold null or non-finite components, and rows without id, take no part. A repeated id counts once per distinct
vector. Queries with fewer candidates than k return them all. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sentinel.functions.storage import cut_lineage
from sentinel.llm.common import row_key

CHUNK = 2048
MAX_CENTROIDS = 256


@dataclass(frozen=True)
class Codebooks:
    first: np.ndarray
    second: np.ndarray
    share: float

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.first.shape[1]
        return _squared(unit[:, :h], self.first), _squared(unit[:, h:], self.second)

    def cells(self, unit: np.ndarray) -> np.ndarray:
        a, b = self.distances(unit)
        return a.argmin(axis=1) * len(self.second) + b.argmin(axis=1)


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x**2).sum(axis=1)[:, None] - 2 * x @ c.T + (c**2).sum(axis=1)


def visits(a: np.ndarray, b: np.ndarray, counts: np.ndarray, wanted: float) -> list[int]:
    """Cells in the order of summed distance until they hold ``wanted`` entries; empty cells are passed over."""
    order_a, order_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    heap, seen, found, held = [(a[order_a[0]] + b[order_b[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        cell = int(order_a[i]) * len(b) + int(order_b[j])
        if counts[cell]:
            found.append(cell)
            held += counts[cell]
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (a[order_a[x]] + b[order_b[y]], x, y))
    return found


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = _squared(x, centres).argmin(axis=1)
        size = np.bincount(near, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], x[rng.choice(len(x), k)])
    return centres


def fit_codebooks(unit: np.ndarray, entries: int, k: int, recall: float, per_cell: int, seed: int = 3, probes: int = 200) -> Codebooks:
    """Codebooks of about sqrt(entries / per_cell) centroids, and the share of entries a search must visit."""
    rng = np.random.default_rng(seed)
    half, different = unit.shape[1] // 2, len(np.unique(unit, axis=0))
    size = min(max(round(np.sqrt(entries / per_cell)), 4), MAX_CENTROIDS, different)
    books = Codebooks(kmeans(unit[:, :half], size, rng), kmeans(unit[:, half:], size, rng), 1.0)
    if size == 1:
        return books
    cell = books.cells(unit)
    counts = np.bincount(cell, minlength=size * size)
    needed = []
    for q in rng.choice(len(unit), min(probes, len(unit)), replace=False):
        closest = np.argsort(-(unit @ unit[q]), kind="stable")[:k + 1]
        a, b = books.distances(unit[q:q + 1])
        order = np.array(visits(a[0], b[0], counts, len(unit)))
        held = np.zeros(size * size)
        held[order] = np.cumsum(counts[order]) / len(unit)
        needed.extend(held[cell[i]] for i in closest if i != q)
    return Codebooks(books.first, books.second, float(np.quantile(needed, recall)))


def _usable(vector: Column) -> Column:
    good = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & good & F.exists(vector, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors as doubles, each scaled by a power of two (which loses nothing) to avoid overflow; two columns at least."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(lists):
        return np.zeros((0, 2))
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x if x.shape[1] > 1 else np.hstack([x, np.zeros((len(x), 1))])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable_rows(vectors: DataFrame, is_query: Column, id_col: str, vector: str) -> DataFrame:
    """Usable rows: id, h (key of the vector), v, and q (whether the row is a query)."""
    kind = dict(vectors.dtypes)[vector]
    v = F.col(vector) if kind in ("array<float>", "array<double>") else F.col(vector).cast("array<double>")
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where(
        F.col("id").isNotNull() & _usable(F.col("v"))).withColumn("h", row_key("v"))


def _indexed(rows: DataFrame, k: int) -> DataFrame:
    """One entry per distinct vector with its k+1 smallest ids. The limit per window is applied before the shuffle, too."""
    first = W.partitionBy("h").orderBy("id")
    ids = rows.select("h", "id").distinct().withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k + 1)
    ids = ids.groupBy("h").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return rows.groupBy("h").agg(F.first("v").alias("v"), F.max("q").alias("q")).join(ids, "h")


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector: str = "embedding",
           recall: float = 0.97, sample_rows: int = 20_000, per_cell: int = 500) -> DataFrame:
    """query_id, rank, the neighbour's id and score for every usable row that ``is_query`` marks, against all rows."""
    rows = usable_rows(vectors, is_query, id_col, vector)
    asked = F.max("q").alias("asked")
    widths = sorted(r["w"] for r in rows.groupBy(F.size("v").alias("w")).agg(asked).collect() if r["asked"])  # one row per length
    if not widths:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias(id_col), F.lit(0.0).alias("score")).where("false")
    parts = [_search_width(rows.where(F.size("v") == w), k, id_col, recall, sample_rows, per_cell) for w in widths]
    return reduce(DataFrame.unionByName, parts)


def _search_width(rows: DataFrame, k: int, id_col: str, recall: float, sample_rows: int, per_cell: int) -> DataFrame:
    """The answers of all queries among usable rows of one length."""
    kept = rows.select("id", "h", "v").orderBy(F.xxhash64("id"), "id", "h").limit(sample_rows).select("v").toArrow()
    entries = cut_lineage(_indexed(rows, k))
    total = entries.count()
    books = fit_codebooks(_unit(_matrix(kept.column("v"))), total, k, recall, per_cell)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = books.cells(_unit(_matrix(batch.column("v")))) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64())], [*batch.schema.names, "cell"])

    placed = entries.mapInArrow(assign, StructType([*entries.schema.fields, StructField("cell", LongType())]))
    held = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).toArrow()  # bounded by MAX_CENTROIDS squared
    counts = np.zeros(len(books.first) * len(books.second), np.int64)
    counts[held.column("cell").to_numpy()] = held.column("n").to_numpy()

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = books.distances(_unit(_matrix(batch.column("v")))) if batch.num_rows else ((), ())
            cells = [visits(x, y, counts, books.share * total) for x, y in zip(a, b)]
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("v"), pa.array(cells, pa.list_(pa.int64()))], ["qh", "qv", "cells"])

    queries = entries.where("q").select("h", "v")
    kind = dict(entries.dtypes)["v"]
    probes = queries.mapInArrow(probe, f"qh string, qv {kind}, cells array<long>").select("qh", "qv", F.explode("cells").alias("cell"))
    asked = probes.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("q_parts"))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("e_parts"))
    plan = asked.join(sizes, "cell")
    part = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = placed.join(plan, "cell").select("cell", "h", "v", F.element_at("ids", 1).alias("low"), F.pmod(F.xxhash64("h"), "e_parts").alias("e"), part("q_parts").alias("p"))
    right = probes.join(plan, "cell").select("cell", "qh", "qv", F.pmod(F.xxhash64("qh"), "q_parts").alias("p"), part("e_parts").alias("e"))

    def compare(block: pa.Table, asking: pa.Table) -> pa.Table:
        x, q = _matrix(block.column("v")), _matrix(asking.column("qv"))
        low = block.column("low").to_numpy()
        out_q, out_e, out_s = [], [], []
        if len(x) and len(q):
            near, wide = _unit(q) @ _unit(x).T, np.sqrt((x * x).sum(axis=1))
            for i in range(len(q)):
                # All entries within rounding of the (k+1)th best are scored, then cut by score and smallest id.
                edge = np.partition(near[i], len(x) - k - 1)[len(x) - k - 1] if len(x) > k + 1 else -2.0
                at = np.flatnonzero(near[i] >= edge - 1e-12)
                s = (x[at] * q[i]).sum(axis=1) / (wide[at] * np.sqrt((q[i] * q[i]).sum()))
                best = np.lexsort((low[at], -s))[:k + 1]
                out_q += [i] * len(best)
                out_e += at[best].tolist()
                out_s += s[best].tolist()
        return pa.table({"qh": asking.column("qh").take(pa.array(out_q, pa.int64())), "h": block.column("h").take(pa.array(out_e, pa.int64())),
                         "low": block.column("low").take(pa.array(out_e, pa.int64())), "score": pa.array(out_s, pa.float64())})

    found = left.groupBy("cell", "e", "p").cogroup(right.groupBy("cell", "e", "p")).applyInArrow(compare, "qh string, h string, low long, score double")
    ranked = found.withColumn("_r", F.row_number().over(W.partitionBy("qh").orderBy(F.desc("score"), "low"))).where(F.col("_r") <= k + 1)
    ranked = ranked.join(entries.select("h", "ids"), "h").select("qh", "h", "score", "ids")
    asked_rows = rows.where("q").select(F.col("id").alias("query_id"), F.col("h").alias("qh")).distinct()
    answers = asked_rows.join(ranked, "qh").select("query_id", "qh", "h", "score", F.explode("ids").alias("id"))
    answers = answers.where((F.col("h") != F.col("qh")) | (F.col("id") != F.col("query_id")))
    place = F.row_number().over(W.partitionBy("query_id", "qh").orderBy(F.desc("score"), "id"))
    return answers.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
