"""Near duplicates by circulant MinHash, banding, and exact Jaccard similarity of five-word shingles.

Signatures. A shingle's hash names a place among 2^20. The first permutation moves the place; the second,
shifted by k places, gives coordinate k, so one table of the second permutation holds all coordinates of
a place side by side. Signatures only propose; links are confirmed on the full shingle sets.

Links. Texts with equal shingle sets form one class, represented by its smallest doc_id. A band value
shared by several classes is a bucket. Small buckets are compared pair by pair, larger ones first with
their smallest member. Larger buckets whose members still lie in different components are then cut into
blocks of bounded size; every pair of blocks is compared exactly inside a task, which returns a spanning
forest of the links that it finds. So no connection that a bucket can show is lost, no group is held
whole by a task, and no list of pairs is written.

Defined cases: a null text or one without words has an empty set and is linked with nothing. Fewer than
five words form one shingle. Rows that share a doc_id are one document for linking, and each gets the
component of that doc_id. A row without doc_id takes no part in linking: component_id is null and kept is
true. Other columns pass through ``near_duplicates`` unchanged. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinel.functions.storage import cut_lineage
from sentinel.llm.common import Texts, bounded_slices, codes, mix64, seen_before
from sentinel.llm.components import components

SHINGLE_WORDS = 5
PLACES = 1 << 20
BANDS, ROWS = 20, 5
PAIRWISE = 6
BLOCK_SHINGLES = 400_000
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


@cache
def permutations(coordinates: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and rows of the second: row p holds its values at p, p+1, ... (circular)."""
    rng = np.random.default_rng(seed)
    first, second = rng.permutation(PLACES), rng.permutation(PLACES).astype(np.uint32)
    circular = np.concatenate([second, second[:coordinates]])
    return first, np.lib.stride_tricks.sliding_window_view(circular, coordinates)[:PLACES]


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, text after text, and the number of the text of each."""
    t = Texts(texts, lower=True)
    words, row = t.words()
    code, vocabulary = codes(words)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, vocabulary.cast(pa.binary()).to_pylist()), np.uint64, len(vocabulary))[code]
    lengths, windows = np.bincount(row, minlength=t.n), max(len(row) - SHINGLE_WORDS + 1, 0)
    at = np.flatnonzero(row[len(row) - windows:] == row[:windows])
    total = np.zeros(windows, np.uint64)
    for k in range(SHINGLE_WORDS if windows else 0):
        total += hashes[k:k + windows] * _MULTIPLIERS[k]
    shingle = mix64(total[at])
    owner = row[at]
    short = np.flatnonzero((lengths > 0) & (lengths < SHINGLE_WORDS))
    if len(short):
        heads = np.concatenate([[0], np.cumsum(lengths)])
        extra = []
        for i in short:
            value = np.array([lengths[i]], np.uint64)
            for h in hashes[heads[i]:heads[i + 1]]:
                value = mix64(value * _MULTIPLIERS[0] + h)
            extra.append(value[0])
        shingle, owner = np.concatenate([shingle, np.array(extra, np.uint64)]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        shingle, owner = shingle[order], owner[order]
    if len(shingle):
        again, _ = seen_before(owner, shingle)
        new = np.ones(len(shingle), bool)
        new[again] = False
        shingle, owner = shingle[new], owner[new]
    return shingle, owner


def signatures(shingle: np.ndarray, coordinates: int, heads: np.ndarray, seed: int, step: int = 1 << 14) -> np.ndarray:
    """Coordinate k of a set: the smallest value of the second permutation, shifted by k, over the set's places."""
    first, second = permutations(coordinates, seed)
    place = first[(shingle >> np.uint64(44)).astype(np.int64)]
    out = np.full((len(heads), coordinates), np.iinfo(np.uint32).max, np.uint32)
    for start in range(0, len(place), step):
        stop = min(start + step, len(place))
        lo, hi = np.searchsorted(heads, start, side="right") - 1, np.searchsorted(heads, stop, side="left")
        cuts = np.maximum(heads[lo:hi] - start, 0)
        np.minimum(out[lo:hi], np.minimum.reduceat(second[place[start:stop]], cuts, axis=0), out=out[lo:hi])
    return out


def band_values(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit number per band; the band's position is part of it."""
    out = np.empty((len(signature), bands), np.uint64)
    for b in range(bands):
        value = np.full(len(signature), b + 1, np.uint64)
        for r in range(rows):
            value = mix64(value * _MULTIPLIERS[1] + signature[:, b * rows + r].astype(np.uint64))
        out[:, b] = value
    return out.view(np.int64)


def sketch(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, seed: int = 6) -> DataFrame:
    """doc_id, n_shingles, two numbers that identify the shingle set, and the band values (empty for an empty set)."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bounded_slices(batches, "text"):
            shingle, owner = shingle_sets(part.column("text"))
            n = np.bincount(owner, minlength=part.num_rows)
            filled = np.flatnonzero(n)
            heads = (np.concatenate([[0], np.cumsum(n)])[:-1])[filled]
            keys = [np.zeros(part.num_rows, np.uint64) for _ in range(2)]
            offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]).astype(np.int32)
            values = np.zeros(0, np.int64)
            if len(filled):
                for k, key in enumerate(keys):
                    key[filled] = np.add.reduceat(mix64(shingle ^ _MULTIPLIERS[k]), heads)
                values = band_values(signatures(shingle, bands * rows, heads, seed), bands, rows).ravel()
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n.astype(np.int64)), *(pa.array(k.view(np.int64)) for k in keys),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                ["doc_id", "n_shingles", "key1", "key2", "bands"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        sketched, f"doc_id {id_type}, n_shingles long, key1 long, key2 long, bands array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    """text to node (the first number of the set's key) and shingles."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bounded_slices(batches, "text"):
            shingle, owner = shingle_sets(part.column("text"))
            n = np.bincount(owner, minlength=part.num_rows)
            node = np.zeros(part.num_rows, np.uint64)
            if len(shingle):
                heads = np.concatenate([[0], np.cumsum(n)])[:-1][n > 0]
                node[n > 0] = np.add.reduceat(mix64(shingle ^ _MULTIPLIERS[0]), heads)
            offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(shingle.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), lists], ["node", "shingles"])

    return docs.select("text").mapInArrow(listed, "node long, shingles array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets are similar enough; shuffles one set per pair and side."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("_y"))
    both = pairs.join(right, "b").join(left, "a")
    common = F.size(F.array_intersect("_x", "_y")).cast("long")
    union = F.size("_x") + F.size("_y") - common
    return both.where(100 * common >= percent * union).select("a", "b")


def _forest(nodes: np.ndarray, group: np.ndarray, side: np.ndarray, shingles: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Spanning forest of the links between rows of different components, and of different blocks unless there is one block."""
    size = np.array([len(s) for s in shingles], np.int64)
    values, inverse = np.unique(np.concatenate(shingles), return_inverse=True)
    owner = np.repeat(np.arange(len(size)), size)
    by_value = np.argsort(inverse, kind="stable")
    posting, heads = owner[by_value], np.concatenate([[0], np.cumsum(np.bincount(inverse, minlength=len(values)))])
    starts = np.concatenate([[0], np.cumsum(size)])
    _, root = np.unique(group, return_inverse=True)
    root, links, two = root.copy(), [], len(np.unique(side)) > 1
    for i in range(len(size)):
        mine = inverse[starts[i]:starts[i + 1]]
        counts = heads[mine + 1] - heads[mine]
        where = np.repeat(heads[mine] - np.concatenate([[0], np.cumsum(counts)])[:-1], counts) + np.arange(counts.sum())
        common = np.bincount(posting[where], minlength=len(size))
        near = 100 * common >= percent * (size + size[i] - common)
        near &= root != root[i]
        if two:
            near &= side != side[i]
        for j in np.flatnonzero(near):
            if root[j] != root[i]:
                links.append((int(nodes[i]), int(nodes[j])))
                root[root == root[j]] = root[i]
    return links


def _within_blocks(members: DataFrame, sets: DataFrame, labels: DataFrame, percent: int, block_shingles: int) -> DataFrame:
    """Links between members of one bucket that lie in different components, found block against block."""
    labelled = members.join(labels, "node", "left").select(
        "bucket", "node", "n_shingles", F.coalesce("component", "node").alias("component"))
    open_buckets = labelled.groupBy("bucket").agg(
        F.min("component").alias("_lo"), F.max("component").alias("_hi"), F.sum("n_shingles").alias("_mass")
    ).where("_lo < _hi").select("bucket", F.ceil(F.col("_mass") / block_shingles).alias("blocks"))
    placed = labelled.join(open_buckets, "bucket").withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), "blocks"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("node", "component", F.col("block").alias("side"), F.xxhash64(
        "bucket", F.least("block", "other"), F.greatest("block", "other")).alias("task"))
    full = met.join(sets, "node").select("task", "node", "component", "side", "shingles")

    def compare(table: pa.Table) -> pa.Table:
        lists = table.column("shingles").combine_chunks()
        flat, cuts = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        cuts = cuts - cuts[0]
        found = _forest(table.column("node").to_numpy(), table.column("component").to_numpy(), table.column("side").to_numpy(),
                        [flat[cuts[i]:cuts[i + 1]] for i in range(len(cuts) - 1)], percent)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return full.groupBy("task").applyInArrow(compare, "a long, b long")


def classes_of(sketches: DataFrame) -> DataFrame:
    """One row per distinct shingle set: node (its key), n_shingles, bands, and rep (its smallest doc_id)."""
    known = sketches.where("n_shingles > 0 AND doc_id IS NOT NULL")
    return known.groupBy("key1", "key2", "n_shingles").agg(
        F.min("doc_id").alias("rep"), F.first("bands").alias("bands")
    ).select(F.col("key1").alias("node"), "n_shingles", "rep", "bands")


def link_classes(docs: DataFrame, classes: DataFrame, percent: int = 85, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Links (a, b) between class nodes that connect all classes a bucket shows to be near."""
    slots = classes.select("node", "n_shingles", F.explode("bands").alias("bucket"))
    shared = slots.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("hub")).where("members > 1")
    members = cut_lineage(slots.join(shared, "bucket"))
    few = members.where(F.col("members") <= PAIRWISE).groupBy("bucket").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    pairwise = few.select(F.explode(F.flatten(F.transform("nodes", lambda x: F.transform(
        F.filter("nodes", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("_p")).select("_p.a", "_p.b")
    crowded = members.where(F.col("members") > PAIRWISE).select("bucket", "node", "n_shingles", "hub")
    to_hub = crowded.where("node > hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    sizes = classes.select("node", "n_shingles")
    pairs = cut_lineage(
        pairwise.union(to_hub).distinct().join(sizes.toDF("a", "_na"), "a").join(sizes.toDF("b", "_nb"), "b")
        .where(100 * F.least("_na", "_nb") >= percent * F.greatest("_na", "_nb")).select("a", "b"))
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).union(crowded.select("node"))
    holders = needed.distinct().join(classes, "node").select(F.col("rep").alias("doc_id")).distinct()
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text").join(holders, "doc_id")
    sets = cut_lineage(_sets(texts).groupBy("node").agg(F.first("shingles").alias("shingles")))
    links = cut_lineage(_verified(pairs, sets, percent))
    return links.union(_within_blocks(crowded, sets, components(links), percent, block_shingles))


def near_duplicates(docs: DataFrame, percent: int = 85, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (columns doc_id and text are read)."""
    sketches = cut_lineage(sketch(docs, bands, rows))
    classes = cut_lineage(classes_of(sketches))
    return place(sketches, classes, link_classes(docs, classes, percent))


def place(sketches: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """Component of every row. Documents that occur with several texts connect the classes of these texts."""
    known = sketches.where("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", F.col("key1").alias("node"))
    several = known.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("_hi")).where("a <> _hi").select("doc_id", "a")
    within = known.join(several, "doc_id").select("a", F.col("node").alias("b")).distinct()
    labels = components(links.select("a", "b").union(within))
    grouped = classes.select("node", "rep").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = grouped.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = grouped.join(lowest, "component").select(F.col("node").alias("key1"), "component_id")
    out = sketches.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("key1")).alias("key1"))
    out = out.join(of_class, "key1", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
