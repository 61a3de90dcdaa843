"""Oversampling of small classes between near neighbours, with exact neighbours at scale.

The neighbour join partitions the rows by pivots at two levels into leaves of about ``chunk_rows`` rows. Every row is first searched in
the part of its leaf that it lies in; its k-th distance there and the triangle inequality then decide which other leaves can hold one of its
k nearest (after Lu et al., 2012), and only to those it is sent. The pivots of the first level are at most ``MAX_PIVOTS`` and known to the
driver; those of the second level split cells of more than ``chunk_rows`` rows and stay in tables. Work on a cell or leaf is cut into groups
of bounded size, so none depends on the share of a hot cell or on equal rows. Only k candidates per row leave a group.

Where distances prune nothing the exact search is quadratic: a row meets all rows of its class. It is then stored once for each
``chunk_rows`` rows of its class, since there are no more cells than that; a class of at most ``chunk_rows`` rows is searched without copies.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sentinel.functions.joins import explode_copies
from sentinel.functions.rand import fast_uniform, uniform
from sentinel.functions.storage import cut_lineage
from sentinel.operators.gradients import batch_matrix
from sentinel.operators.ranking import mark_smallest

CHUNK_ROWS = 16_000
MAX_PIVOTS = 1024
SLICE_ROWS, SLICE_VALUES = 256, 1 << 22  # a search holds the distances of so many rows, and so many numbers of differences, at a time


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a ** 2).sum(1)[:, None] + (b ** 2).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def _matrix(table: pa.Table, column: str = "x") -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    values = table.column(column).combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(table.num_rows, -1)


def _closest(asking: np.ndarray, ids: np.ndarray, rows: np.ndarray, other: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``asking``, row of ``rows``, distance) of the k nearest with another id, nearest first, ties to the earlier of ``rows``.

    Products of matrices find the rows that may be among the k nearest, up to their rounding error; differences give the distances.
    """
    square, dim = (rows ** 2).sum(1), rows.shape[1]
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for start in range(0, len(asking), SLICE_ROWS):
        part = asking[start:start + SLICE_ROWS]
        own = (part ** 2).sum(1)
        d = own[:, None] + square[None, :] - 2.0 * (part @ rows.T)
        d[ids[start:start + SLICE_ROWS, None] == other[None, :]] = np.inf
        last = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.full(len(part), np.inf)
        slack = 8 * (dim + 2) * np.finfo(float).eps * (own + np.max(square, initial=0.0, where=np.isfinite(square)))
        limit = np.where(np.isnan(last), np.inf, last + slack)
        who, at = np.nonzero((d <= limit[:, None]) & np.isfinite(d))
        step = max(1, SLICE_VALUES // max(1, dim))
        exact = np.concatenate([np.zeros(0), *[np.sqrt(((part[who[i:i + step]] - rows[at[i:i + step]]) ** 2).sum(1)) for i in range(0, len(who), step)]])
        order = np.lexsort((at, exact, who))
        who, at, exact = who[order], at[order], exact[order]
        ok = np.arange(len(who)) - np.searchsorted(who, who) < k
        found.append((who[ok] + start, at[ok], exact[ok]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _met(run: Callable[[pa.Table, pa.Table], pa.Table], columns: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """``run`` for groups that both sides have; no rows for others."""
    none = to_arrow_schema(StructType.fromDDL(columns)).empty_table()
    return lambda a, b: run(a, b) if a.num_rows and b.num_rows else none


def _own(df: DataFrame) -> DataFrame:
    """The same table with columns of its own, so that it can meet a relative in a cogroup."""
    return df.toDF(*df.columns)


def _parts(rows: DataFrame, by: Sequence[str], size: int) -> DataFrame:
    """(by, parts): in how many groups of about ``size`` rows the rows of each key are cut."""
    return rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("parts"))


def _dealt(rows: DataFrame, parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Every row in one part of its key."""
    return rows.join(parts, list(by)).withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).drop("parts")


def _repeated(rows: DataFrame, parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Every row once in each part of its key."""
    return rows.join(parts, list(by)).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


def nearest_neighbors(rows: DataFrame, key: str, features: str, label: str, k: int = 5,
                      n_pivots: int | None = None, chunk_rows: int = CHUNK_ROWS, seed: int = 42) -> DataFrame:
    """(key, label, rank, neighbor, distance): the k nearest other rows of the same class."""
    x = F.col(features) if rows.select(features).schema[0].dataType.simpleString() == "array<float>" else F.col(features).cast("array<double>")
    base = cut_lineage(rows.select(F.col(key).alias("id"), F.col(label).cast("int").alias("cls"), x.alias("x")))
    if n_pivots is None:
        largest = base.groupBy("cls").count().agg(F.max("count")).first()[0] or 0
        n_pivots = min(math.ceil(largest / chunk_rows), MAX_PIVOTS)
    drawn = base.orderBy(uniform(seed, "pivot", "id"), "id").limit(n_pivots).collect()
    if not drawn:
        raise ValueError("no rows to search")
    pivots = np.array([r["x"] for r in drawn], dtype=float)
    id_type, x_type = (base.schema[c].dataType.simpleString() for c in ("id", "x"))
    row = f"id {id_type}, cls int, x {x_type}"

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = _distances(batch_matrix(b, "x"), pivots)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), b.column("cls"), b.column("x"), pa.array(cell, pa.int32()),
                     pa.array(d[np.arange(len(cell)), cell], pa.float64())],
                    names=["id", "cls", "x", "cell", "away"])

    placed = cut_lineage(base.mapInArrow(to_cells, f"{row}, cell int, away double"))
    # classes times MAX_PIVOTS rows
    stats = placed.groupBy("cls", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).toArrow()
    of_class, cell_of, n, radius = (stats.column(c).to_numpy() for c in ("cls", "cell", "n", "radius"))
    between, longest = _distances(pivots, pivots), (pivots ** 2).sum(1).max()

    # within[cls][cell]: a distance from the cell's pivot that surely covers k + 1 rows of the class
    within: dict[int, np.ndarray] = {}
    members: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for cls in np.unique(of_class):
        own = of_class == cls
        cells, sizes, radii = cell_of[own], n[own], radius[own]
        far = between[:, cells] + radii
        order = np.argsort(far, axis=1)
        covered = np.cumsum(sizes[order], axis=1) >= k + 1
        first = np.take_along_axis(order, covered.argmax(axis=1)[:, None], 1)
        within[cls] = np.where(covered.any(axis=1), np.take_along_axis(far, first, 1)[:, 0], np.inf)
        members[cls] = cells, radii, sizes > chunk_rows

    cell, leaf = ["cls", "cell"], ["cls", "cell", "leaf"]
    leaves, leaf_stats = _leaves(placed, pivots, chunk_rows, seed, row)
    chunks = leaf_stats.select(*leaf, F.ceil(F.col("n") / chunk_rows).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("id", F.lit(1)), "chunks").cast("int").alias("chunk")
    held = leaves.join(chunks, leaf)

    def at_home(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        x, ids = _matrix(table), table.column("id").to_numpy()
        who, at, distance = _closest(x, ids, x, ids, k)
        starts = np.searchsorted(who, np.arange(len(ids) + 1))
        close = np.full(len(ids), np.inf)
        full = np.diff(starts) == k
        close[full] = distance[starts[1:][full] - 1]
        lists = pa.array(starts, pa.int32())
        return table.select(["id", "cls", "x", "cell", "away", "leaf", "chunk"]).append_column("close", pa.array(close)).append_column(
            "others", pa.ListArray.from_arrays(lists, table.column("id").combine_chunks().take(pa.array(at)))).append_column(
            "distances", pa.ListArray.from_arrays(lists, pa.array(distance)))

    home = cut_lineage(held.select("id", "cls", "x", "cell", "away", "leaf", chunk).groupBy(*leaf, "chunk").applyInArrow(
        at_home, f"{row}, cell int, away double, leaf long, chunk int, close double, others array<{id_type}>, distances array<double>"))
    result = f"id {id_type}, cls int, neighbor {id_type}, distance double"
    near_home = home.select("id", "cls", F.explode(F.arrays_zip(F.col("others").alias("neighbor"), F.col("distances").alias("distance"))).alias("f")).select(
        "id", "cls", "f.neighbor", "f.distance")

    def to_targets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            cls, at = b.column("cls").to_numpy(), b.column("cell").to_numpy()
            x = batch_matrix(b, "x")
            d = _distances(x, pivots)
            coarse = np.array([within[c][p] for c, p in zip(cls, at)]) + b.column("away").to_numpy()
            error = np.sqrt(8 * x.shape[1] * np.finfo(float).eps * np.maximum((x ** 2).sum(1), longest))  # of a distance near 0 that products give
            reach = np.fmin(coarse, b.column("close").to_numpy()) * (1 + 1e-9) + 1e-9 + 2 * error
            for c in np.unique(cls):
                cells, radii, split = members[c]
                mine = np.flatnonzero(cls == c)
                # a cell that is not split has been searched as a whole by its own rows
                ask = (d[np.ix_(mine, cells)] - radii <= reach[mine][:, None]) & (split | (at[mine][:, None] != cells))
                who, target = np.nonzero(ask)
                take = pa.array(mine[who])
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(take), b.column("cls").take(take), b.column("x").take(take), pa.array(reach[mine][who]),
                     *[b.column(v).take(take) for v in ("cell", "leaf", "chunk")], pa.array(cells[target], pa.int32())],
                    names=["id", "cls", "x", "reach", "own_cell", "own_leaf", "own_chunk", "cell"])

    asker = f"{row}, reach double, own_cell int, own_leaf long, own_chunk int, cell int"
    sent = cut_lineage(home.select("id", "cls", "x", "cell", "away", "leaf", "chunk", "close").mapInArrow(to_targets, asker))

    def to_leaves(asking: pa.Table, near: pa.Table) -> pa.Table:
        ok = _distances(_matrix(asking), _matrix(near, "p")) - near.column("radius").to_numpy() <= asking.column("reach").to_numpy()[:, None]
        who, which = np.nonzero(ok)
        take = pa.array(who)
        names = ["id", "cls", "x", "reach", "own_cell", "own_leaf", "own_chunk", "cell"]
        return asking.select(names).take(take).append_column("leaf", near.column("leaf").take(pa.array(which)))

    parts = _parts(sent, cell, chunk_rows)
    sides = _dealt(sent, parts, cell).groupBy(*cell, "part").cogroup(_own(_repeated(leaf_stats, parts, cell)).groupBy(*cell, "part"))
    columns = f"{asker}, leaf long"
    queries = cut_lineage(sides.applyInArrow(_met(to_leaves, columns), columns))

    # rows of a leaf are cut into chunks, its searchers into parts; each (chunk, part) is one group
    plan = _parts(queries, leaf, chunk_rows).join(chunks, leaf)
    elsewhere = ~((F.col("cell") == F.col("own_cell")) & (F.col("leaf") == F.col("own_leaf")) & (F.col("chunk") == F.col("own_chunk")))
    left = queries.join(plan, leaf).select("id", "cls", "x", "reach", "own_cell", "own_leaf", "own_chunk", "cell", "leaf", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"),
                                           F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")).where(elsewhere).drop("own_cell", "own_leaf", "own_chunk")
    right = leaves.join(plan, leaf).select(F.col("id").alias("other"), "cls", "x", "cell", "leaf", chunk,
                                           F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    group = [*leaf, "chunk", "part"]

    def search(asking: pa.Table, rows_of: pa.Table) -> pa.Table:
        rows_of = rows_of.sort_by("other")
        who, at, distance = _closest(_matrix(asking), asking.column("id").to_numpy(), _matrix(rows_of), rows_of.column("other").to_numpy(), k)
        ok = distance <= asking.column("reach").to_numpy()[who]
        take = pa.array(who[ok])
        return pa.table({"id": asking.column("id").take(take), "cls": asking.column("cls").take(take),
                         "neighbor": rows_of.column("other").take(pa.array(at[ok])), "distance": pa.array(distance[ok])})

    far_off = left.groupBy(*group).cogroup(_own(right).groupBy(*group)).applyInArrow(_met(search, result), result)
    w = Window.partitionBy("id").orderBy("distance", "neighbor")
    return near_home.unionByName(far_off).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        F.col("id").alias(key), F.col("cls").alias(label), "rank", "neighbor", "distance")


def _leaves(placed: DataFrame, pivots: np.ndarray, chunk_rows: int, seed: int, row: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their leaf and their distance from its pivot (``near``), and per leaf its pivot ``p``, radius and number of rows.

    A cell's pivot is the pivot of its leaf 0; in cells of more than ``chunk_rows`` rows one in ``chunk_rows``, by keyed draw, is the pivot of a leaf of its own.
    """
    spark, cell = placed.sparkSession, ["cls", "cell"]
    first = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(pivots)], "cell int, p array<double>")
    cells = placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")).join(F.broadcast(first), "cell")
    drawn = placed.where(fast_uniform(str(seed), F.lit("leaf"), F.col("id")) < 1.0 / chunk_rows).join(cells.where(F.col("_n") > chunk_rows).select(*cell), cell).select(
        *cell, F.xxhash64("id").alias("leaf"), F.col("x").cast("array<double>").alias("p"))
    seconds = cut_lineage(cells.select(*cell, F.lit(0).cast("long").alias("leaf"), "p").unionByName(drawn))

    def assign(members: pa.Table, near: pa.Table) -> pa.Table:
        near = near.sort_by("leaf")
        d = _distances(_matrix(members), _matrix(near, "p"))
        at = d.argmin(1)
        return pa.table({"id": members.column("id"), "cls": members.column("cls"), "x": members.column("x"), "cell": members.column("cell"),
                         "away": members.column("away"), "leaf": near.column("leaf").take(pa.array(at)), "near": pa.array(d[np.arange(len(at)), at])})

    parts = _parts(placed, cell, 4 * chunk_rows)
    sides = _dealt(placed, parts, cell).groupBy(*cell, "part").cogroup(_own(_repeated(seconds, parts, cell)).groupBy(*cell, "part"))
    columns = f"{row}, cell int, away double, leaf long, near double"
    leaves = cut_lineage(sides.applyInArrow(_met(assign, columns), columns))
    stats = leaves.groupBy(*cell, "leaf").agg(F.count(F.lit(1)).alias("n"), F.max("near").alias("radius"))
    return leaves, cut_lineage(stats.join(seconds, [*cell, "leaf"]))


def smote(rows: DataFrame, key: str, features: str, label: str, k: int = 5, seed: int = 42,
          **search: int) -> DataFrame:
    """Synthetic rows (label, features, origin, neighbor) that lift every class to the largest one.

    Each class of n rows needs m new rows: every row gives floor(m / n) and the first m mod n rows,
    by keyed draw, one more. A class of one row, or rows without a class, are an error. A new row lies at a random point between its origin and one of the
    origin's k nearest neighbours.
    """
    counts = {r["c"]: r["count"] for r in
              rows.groupBy(F.col(label).cast("int").alias("c")).count().collect()}
    if None in counts:
        raise ValueError(f"{counts[None]} rows have no class")
    most = max(counts.values())
    small = {c: n for c, n in counts.items() if n < most}
    if not small:
        raise ValueError("all classes have the same size")
    alone = sorted(str(c) for c, n in small.items() if n < 2)
    if alone:
        raise ValueError(f"classes without a second row have no neighbours: {', '.join(alone)}")
    slim = rows.select(F.col(key).alias("id"), F.col(label).cast("int").alias("cls"), F.col(features).alias("x"))
    minority = slim.where(F.col("cls").isin(list(small)))
    near = cut_lineage(nearest_neighbors(minority, "id", "x", "cls", k, seed=seed, **search))  # read twice
    extra = lambda n: F.pmod(F.lit(most) - n, n)
    drawn = minority.withColumn("_draw", uniform(seed, "smote", "id"))
    origin = mark_smallest(drawn, ["cls"], "_draw", "id", {"_more": extra})
    each = F.create_map(*[v for c, n in small.items() for v in (F.lit(c), F.lit((most - n) // n))])
    copies = F.element_at(each, F.col("cls")) + F.col("_more").cast("int")
    planned = explode_copies(origin.withColumn("_copies", copies), "_copies")
    sizes = near.groupBy("id").agg(F.max("rank").alias("_k"))
    chosen = planned.join(sizes, "id").withColumn(
        "rank", (F.floor(uniform(seed, "pick", "id", "copy") * F.col("_k")) + 1).cast("int"))
    other = slim.select(F.col("id").alias("neighbor"), F.col("x").alias("_nx"))
    joined = chosen.join(near.select("id", "rank", "neighbor"), ["id", "rank"]).join(other, "neighbor")
    step = uniform(seed, "step", "id", "copy")
    return joined.withColumn("_step", step).select(
        F.col("cls").alias(label),
        F.zip_with("x", "_nx", lambda a, b: a.cast("double") + F.col("_step") * (b.cast("double") - a.cast("double"))).alias(features),
        F.col("id").alias("origin"), "neighbor", "copy")
