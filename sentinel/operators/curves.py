"""ROC curves of all runs over stored, packed scores.

One pass over the predictions packs them: every task sorts what it has read by run and side and writes lists of scores, about 9 bytes a
score, together with the confusion counts. All else reads that table. Runs with more than ``BLOCK`` different scores are cut into ranges at scores
found in the lists themselves, the lists are cut at the same places without sorting again, and a range is merged in one group. Only sums of a
range leave its group, so neither the number of rows of a run nor scores that lie close together or are equal make a group large.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentinel.functions.cols import ratio
from sentinel.functions.joins import join_null_safe
from sentinel.functions.storage import small_table

BUFFER = 1 << 20  # scores that a task sorts at once
CHUNK = 4096  # longest list
BLOCK = 1 << 19  # scores of a range, about
BINS = 256  # least number of groups that share the runs which are not cut


def _codes(table: pa.Table, names: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code of each row, first row of each code) by the values of ``names``; NULL is a value."""
    code = np.zeros(table.num_rows, np.int64)
    for name in names:
        d = pa.concat_arrays(table.column(name).chunks).dictionary_encode(null_encoding="encode")
        both = code * len(d.dictionary) + d.indices.to_numpy(zero_copy_only=False)
        _, code = np.unique(both, return_inverse=True)
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    return code, first


def _starts(*sorted_by: np.ndarray) -> np.ndarray:
    """Positions at which a run of equal rows begins; NaN is equal to NaN."""
    new = np.zeros(len(sorted_by[0]), bool)
    new[:1] = True
    for v in sorted_by:
        same = v[1:] == v[:-1]
        new[1:] |= ~(same | (np.isnan(v[1:]) & np.isnan(v[:-1]))) if v.dtype.kind == "f" else ~same
    return np.flatnonzero(new)


def _lists(starts: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), pa.array(values))


def pack_scores(df: DataFrame, keys: Sequence[str], truth: Column, scores: Column, counted: Sequence[str] = (), first_class: int = 0) -> DataFrame:
    """Packed scores: rows of (keys, counted, _class, _hit, n, at, times).

    ``scores`` is the list of a row's scores for the classes from ``first_class`` on; a row hits the class that ``truth`` names. Lists are
    sorted and hold a score once, ``times`` is NULL if each was met once. Scores that are NULL have rows without lists; rows without truth
    have no scores. Rows with a NULL class count the rows by (keys, counted).
    """
    keys, counted = list(keys), list(counted)
    named = [*keys, *counted]
    slim = df.select(*named, truth.cast("double").alias("_y"), scores.cast("array<double>").alias("_at"))
    types = dict(slim.dtypes)

    def rows_of(table: pa.Table, by: Sequence[str], first: np.ndarray, **columns: pa.Array) -> pa.RecordBatch:
        at = pa.array(first)
        none = {c: pa.nulls(len(first), table.schema.field(c).type) for c in named}
        kept = none | {c: pa.concat_arrays(table.column(c).chunks).take(at) for c in by}
        empty = {"_class": pa.int32(), "_hit": pa.bool_(), "n": pa.int64(), "at": pa.list_(pa.float64()), "times": pa.list_(pa.int64())}
        rest = {c: columns.get(c, pa.nulls(len(first), t)) for c, t in empty.items()}
        return pa.RecordBatch.from_arrays([*kept.values(), *rest.values()], names=[*kept, *rest])

    def packed(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if counted:
            code, first = _codes(table, named)
            yield rows_of(table, named, first, n=pa.array(np.bincount(code, minlength=len(first))))
        lists = pa.concat_arrays(table.column("_at").chunks)
        length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        row = np.repeat(np.arange(table.num_rows), length)
        truth_of = pa.concat_arrays(table.column("_y").chunks).to_numpy(zero_copy_only=False)[row]
        of = first_class + np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
        known, missing = ~np.isnan(truth_of), flat.is_null().to_numpy(zero_copy_only=False)
        code, first = _codes(table, keys)
        span = int(of.max(initial=first_class)) + 1
        group = (code[row] * span + of) * 2 + (truth_of == of)
        without, n_without = np.unique(group[known & missing], return_counts=True)

        def named_by(group: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array]]:
            return first[group // (2 * span)], {"_class": pa.array((group // 2 % span).astype(np.int32)), "_hit": pa.array(group % 2 == 1)}

        if len(without):
            at, columns = named_by(without)
            yield rows_of(table, keys, at, **columns, n=pa.array(n_without))
        use = known & ~missing
        group, value = group[use], flat.to_numpy(zero_copy_only=False)[use]
        if not len(group):
            return
        order = np.lexsort((value, group))
        group, value = group[order], value[order]
        entry = _starts(group, value)
        times = np.diff(np.append(entry, len(group)))
        group, value = group[entry], value[entry]
        begins = _starts(group)
        place = np.arange(len(group)) - np.repeat(begins, np.diff(np.append(begins, len(group))))
        chunk = np.flatnonzero(place % CHUNK == 0)
        n = np.add.reduceat(times, chunk)
        plain = n == np.diff(np.append(chunk, len(group)))
        at, columns = named_by(group[chunk])
        once = rows_of(table, keys, at, **columns, n=pa.array(n), at=_lists(chunk, value), times=_lists(chunk, times))
        for some, drop in ((plain, True), (~plain, False)):
            if some.any():
                part = pa.Table.from_batches([once]).filter(pa.array(some)).combine_chunks()
                if drop:
                    part = part.set_column(part.num_columns - 1, "times", pa.nulls(part.num_rows, pa.list_(pa.int64())))
                yield from part.to_batches()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += max(b.num_rows, len(b.column("_at").flatten()))
            if size >= BUFFER:
                yield from packed(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield from packed(pa.Table.from_batches(held))

    columns = ", ".join(f"`{c}` {types[c]}" for c in named)
    return slim.mapInArrow(pack, f"{columns}, _class int, _hit boolean, n bigint, at array<double>, times array<bigint>")


def counts(packed: DataFrame, keys: Sequence[str], counted: Sequence[str]) -> DataFrame:
    """Rows per (keys, counted) as ``n``."""
    return packed.where("_class IS NULL").groupBy(*keys, *counted).agg(F.sum("n").alias("n"))


def _cuts(values: DataFrame, keys: list[str]) -> tuple[dict[tuple, np.ndarray], int]:
    """Scores at which the runs of more than BLOCK scores are cut, one per BLOCK scores, and the number of groups for all other runs."""
    size = F.size("at")
    sizes = values.groupBy(*keys).agg(F.sum(size).alias("size")).agg(F.sum("size").alias("all"), F.max("size").alias("most")).first()
    bins = max(BINS, (sizes["all"] or 0) // BLOCK)
    if (sizes["most"] or 0) <= BLOCK:
        return {}, bins
    middle = values.select(*keys, F.get("at", F.floor(size / 2).cast("int")).alias("_cut"), size.alias("_size"))
    run, before = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    placed = middle.withColumn("_all", F.sum("_size").over(run)).withColumn("_upto", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    crossed = F.floor((F.col("_upto") + F.col("_size")) / BLOCK) > F.floor(F.col("_upto") / BLOCK)
    rows = placed.where((F.col("_all") > BLOCK) & crossed & ~F.isnan("_cut")).groupBy(*keys).agg(F.array_sort(F.collect_set("_cut")).alias("_cuts")).collect()
    return {tuple(r[k] for k in keys): np.array(r["_cuts"]) for r in rows}, bins


def _ranges(values: DataFrame, keys: list[str]) -> DataFrame:
    """The lists cut at the limits of the ranges: with ``_block``, the number of the range, and ``_bin``, the group that merges it."""
    cuts, bins = _cuts(values, keys)
    if not cuts:
        return values.withColumn("_block", F.lit(0)).withColumn("_bin", F.pmod(F.xxhash64(*keys), F.lit(bins)))
    names = values.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lists, times = b.column("at"), b.column("times")
            ends = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            row, block, starts = [], [], []
            of = [cuts.get(k) for k in zip(*[b.column(k).to_pylist() for k in keys])]
            for i, limits in enumerate(of):
                if limits is None:
                    row.append([i]), block.append([-1]), starts.append([ends[i]])
                else:
                    at = flat[ends[i]:ends[i + 1]]
                    begin = np.append(0, np.searchsorted(at, limits))
                    some = np.flatnonzero(np.diff(np.append(begin, len(at))))
                    row.append(np.full(len(some), i)), block.append(some), starts.append(ends[i] + begin[some])
            row, block, starts = np.concatenate(row), np.concatenate(block), np.concatenate(starts).astype(np.int64)
            length = np.diff(np.append(starts, len(flat)))
            repeated = np.ones(len(flat), np.int64)
            counted = times.is_valid().to_numpy(zero_copy_only=False)
            repeated[np.repeat(counted, np.diff(ends))] = times.flatten().to_numpy(zero_copy_only=False)
            columns = {c: b.column(c).take(pa.array(row)) for c in names if c not in ("n", "at", "times")}
            columns |= {"n": pa.array(np.add.reduceat(repeated, starts)), "at": _lists(starts, flat)}
            out = pa.table(columns | {"times": _lists(starts, repeated), "_block": pa.array(block.astype(np.int32)), "_length": pa.array(length)})
            plain = pc.equal(out.column("n"), out.column("_length"))
            out = out.drop_columns(["_length"])
            once = out.filter(plain)
            yield from once.set_column(once.schema.get_field_index("times"), "times", pa.nulls(once.num_rows, pa.list_(pa.int64()))).combine_chunks().to_batches()
            yield from out.filter(pc.invert(plain)).combine_chunks().to_batches()

    types = ", ".join(f"`{c}` {t}" for c, t in values.dtypes)
    done = values.select(*names).mapInArrow(cut, f"{types}, _block int")
    whole = F.pmod(F.xxhash64(*keys), F.lit(bins))
    return done.withColumn("_bin", F.when(F.col("_block") < 0, whole).otherwise(F.xxhash64(*keys, "_block"))).withColumn(
        "_block", F.greatest("_block", F.lit(0)))


def _merged(table: pa.Table, by: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code, positives, negatives, first row of each code) per different score of each code, by code and score."""
    code, first = _codes(table, by)
    lists, times = (pa.concat_arrays(table.column(c).chunks) for c in ("at", "times"))
    length = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    value = lists.flatten().to_numpy(zero_copy_only=False)
    repeated = np.ones(len(value), np.int64)
    repeated[np.repeat(times.is_valid().to_numpy(zero_copy_only=False), length)] = times.flatten().to_numpy(zero_copy_only=False)
    hit = np.repeat(pa.concat_arrays(table.column("_hit").chunks).to_numpy(zero_copy_only=False), length)
    code = np.repeat(code, length)
    order = np.lexsort((value, code))
    code, value, repeated, hit = code[order], value[order], repeated[order], hit[order]
    entry = _starts(code, value)
    return code[entry], np.add.reduceat(repeated * hit, entry).astype(float), np.add.reduceat(repeated * ~hit, entry).astype(float), first


def _sums(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _block, p, n, pairs): positives, negatives and, with ties as halves, pairs of both in order, within the range."""
    by = [*keys, "_block"]

    def run(table: pa.Table) -> pa.Table:
        code, p, n, first = _merged(table, by)
        starts = _starts(code)
        before = np.cumsum(n) - n
        before -= np.repeat(before[starts], np.diff(np.append(starts, len(code))))
        at = pa.array(first)
        sums = {"p": p, "n": n, "pairs": p * (before + n * 0.5)}
        return pa.table({c: pa.concat_arrays(table.column(c).chunks).take(at) for c in by} | {c: np.add.reduceat(v, starts) for c, v in sums.items()})

    types = dict(ranges.dtypes)
    columns = ", ".join(f"`{c}` {types[c]}" for c in by)
    return ranges.select(*by, "_bin", "_hit", "at", "times").groupBy("_bin").applyInArrow(run, f"{columns}, p double, n double, pairs double")


def area(packed: DataFrame, keys: Sequence[str], name: str = "roc_auc") -> DataFrame:
    """Tie-aware ROC-AUC per ``keys``, of which ``_class`` may be one; NULL where only one side is present."""
    keys = list(keys)
    sums = _sums(_ranges(packed.where("at IS NOT NULL"), keys), keys)
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    below = sums.withColumn("_below", F.coalesce(F.sum("n").over(earlier), F.lit(0.0)))
    return below.groupBy(*keys).agg(F.try_divide(F.sum(F.col("pairs") + F.col("p") * F.col("_below")), F.sum("p") * F.sum("n")).alias(name))


def highest_tpr(packed: DataFrame, keys: Sequence[str], limits: dict[str, float], auc: str | None = None) -> DataFrame:
    """Largest TPR on the full ROC curve with FPR <= limit, per ``keys``; 0 if there is none. With ``auc`` also the area, under that name.

    Sums of the ranges tell for each limit the one range in which the curve crosses it; only those are merged once more. NULL is
    below all scores.
    """
    keys = list(keys)
    ranges = _ranges(packed.where("at IS NOT NULL"), keys)
    side = lambda hit: F.sum(F.when(hit, F.col("n")).otherwise(0)).cast("double")
    missing = packed.where("_class IS NOT NULL AND at IS NULL").groupBy(*keys).agg(side(F.col("_hit")).alias("p"), side(~F.col("_hit")).alias("n"))
    sums = _sums(ranges, keys).unionByName(missing.select(*keys, F.lit(-1).alias("_block"), "p", "n", F.lit(0.0).alias("pairs")))
    run, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_block")
    above, below = order.rowsBetween(1, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("*", F.sum("p").over(run).alias("_p"), F.sum("n").over(run).alias("_n"), *[
        F.coalesce(F.sum(c).over(above), F.lit(0.0)).alias(f"_{c}_above") for c in ("p", "n")],
        F.coalesce(F.sum(F.when(F.col("_block") >= 0, F.col("n"))).over(below), F.lit(0.0)).alias("_below"))
    sums = small_table(sums)
    upto = lambda c: F.col(f"_{c}_above") + F.col(c)
    tpr, fpr = ratio(upto("p"), F.col("_p")), ratio(upto("n"), F.col("_n"))
    scored = lambda v: F.sum(F.when(F.col("_block") >= 0, v))
    areas = [F.try_divide(scored(F.col("pairs") + F.col("p") * F.col("_below")), scored(F.col("p")) * scored(F.col("n"))).alias(auc)] if auc else []
    ends = sums.groupBy(*keys).agg(*areas, *[F.max(F.when(fpr <= limit, tpr)).alias(f"_end_{name}") for name, limit in limits.items()])
    crossing = F.lit(False)
    for limit in limits.values():
        crossing = crossing | ((fpr > limit) & (ratio(F.col("_n_above"), F.col("_n")) <= limit))
    known = ["_p", "_n", "_p_above", "_n_above"]
    crossed = sums.where((F.col("_block") >= 0) & crossing).select(*keys, "_block", *known)
    met = join_null_safe(ranges, crossed, [*keys, "_block"])

    def run_range(table: pa.Table) -> pa.Table:
        _, p, n, _ = _merged(table, keys)
        all_p, all_n, p_above, n_above = (table.column(c)[0].as_py() for c in known)
        share = lambda v, of: v / of if of else np.zeros(len(v))
        rates = share(p_above + np.cumsum(p[::-1]), all_p), share(n_above + np.cumsum(n[::-1]), all_n)
        best = [rates[0][rates[1] <= limit].max(initial=-1.0) for limit in limits.values()]
        return pa.table({c: table.column(c).slice(0, 1) for c in keys} | {n: pa.array([v if v >= 0 else None], pa.float64()) for n, v in zip(limits, best)})

    types = dict(ranges.dtypes)
    columns = ", ".join([*[f"`{c}` {types[c]}" for c in keys], *[f"`{n}` double" for n in limits]])
    inside = met.select(*keys, "_block", "_hit", "at", "times", *known).groupBy(*keys, "_block").applyInArrow(run_range, columns)
    best = inside.groupBy(*keys).agg(*[F.max(n).alias(f"_in_{n}") for n in limits])
    return join_null_safe(ends, best, keys, "left").select(*keys, *([auc] if auc else []), *[
        F.greatest(F.coalesce(f"_end_{n}", F.lit(0.0)), F.coalesce(f"_in_{n}", F.lit(0.0))).alias(n) for n in limits])
