"""Best-fit packing into sequences of several permitted lengths.

Documents are cut into pieces no longer than the largest length. Pieces are dealt into groups of bounded size, and a
task packs one group: pieces go by falling length into the open bin that they leave fullest. If none has room, a
bin of the permitted length with the least cost per word that it can still be filled with is opened. At the end each bin is reduced to
the smallest permitted length that holds its contents.

Defined cases: a document without words (or a null text) has one piece of length 0 in no bin: bin_id, capacity and
offset are null. Equal rows are numbered (copy) and packed on their own. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentinel.functions.storage import cut_lineage
from sentinel.llm.common import n_words, numbered_copies

CAPACITIES = (512, 1024, 2048)
GROUP_PIECES = 16_384


def cost(capacity: int) -> float:
    """Work of one sequence: linear layers, attention, and a fixed part."""
    return capacity + capacity * capacity / 8192 + 32


def pack_group(sizes: Sequence[int], capacities: Sequence[int] = CAPACITIES, price: Callable[[int], float] = cost) -> tuple[list[int], list[int], list[int]]:
    """Bin, final capacity of the bin, and offset in the bin for each piece; sizes must be in falling order."""
    permitted = sorted(capacities)
    rooms: list[tuple[int, int]] = []
    used: list[int] = []
    bins, offsets, left = [], [], sum(sizes)
    for size in sizes:
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, number = rooms.pop(at)
        else:
            number = len(used)
            used.append(0)
            room = min((c for c in permitted if c >= size), key=lambda c: (price(c) / min(c, left), c))
        bins.append(number)
        offsets.append(used[number])
        used[number] += size
        left -= size
        if room > size:
            insort(rooms, (room - size, number))
    final = [permitted[bisect_left(permitted, u)] for u in used]
    return bins, [final[b] for b in bins], offsets


def pack(docs: DataFrame, length: Column | None = None, capacities: Sequence[int] = CAPACITIES, group_pieces: int = GROUP_PIECES,
         price: Callable[[int], float] = cost) -> DataFrame:
    """doc_id, size and copy (which tell rows apart), piece, start and length in the document, bin_id, capacity, and offset in the bin."""
    largest = max(capacities)
    size = n_words(F.col("text")) if length is None else F.coalesce(length, F.lit(0)).cast("long")
    rows = cut_lineage(numbered_copies(docs.select("doc_id", size.alias("size")), ["doc_id", "size"]))
    last = F.greatest(F.ceil(F.col("size") / largest) - 1, F.lit(0)).cast("long")
    pieces = rows.select("doc_id", "copy", "size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    start = F.col("piece") * largest
    pieces = pieces.select("doc_id", "copy", "piece", start.alias("start"), F.least(F.col("size") - start, F.lit(largest)).alias("length"), "size")
    total = rows.agg(F.sum(last + 1)).first()[0] or 0
    groups = max(-(-total // group_pieces), 1)
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "copy", "size", "piece"), F.lit(groups)))
    full, none = dealt.where("length > 0"), dealt.where("length = 0")
    id_type = dict(docs.dtypes)["doc_id"]

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("copy", "ascending"), ("piece", "ascending"), ("size", "ascending")])
        bins, final, offsets = pack_group(table.column("length").to_pylist(), capacities, price)
        group = table.column("_group").to_numpy()
        numbers = group * (1 << 32) + np.array(bins, np.int64)
        return pa.table({**{c: table.column(c) for c in ("doc_id", "size", "copy", "piece", "start", "length")},
                         "bin_id": pa.array(numbers, pa.int64()), "capacity": pa.array(final, pa.int32()), "offset": pa.array(offsets, pa.int64())})

    schema = f"doc_id {id_type}, size long, copy long, piece long, start long, length long, bin_id long, capacity int, offset long"
    out = full.groupBy("_group").applyInArrow(packed, schema)
    return out.union(none.select("doc_id", "size", "copy", "piece", "start", "length", F.lit(None).cast("long"), F.lit(None).cast("int"), F.lit(None).cast("long")))
