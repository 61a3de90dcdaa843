"""Helpers shared by the operators: words, row keys, copy numbers, and Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

WORD = r"[^\x20\x09-\x0D]+"
COPY_CHUNK = 10_000


def n_words(text: Column) -> Column:
    """Number of words of the whole text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(*cols: Column | str) -> Column:
    """128 bits that identify the values of ``cols``; nulls differ from every value."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    flags = [c.isNull() for c in parts]
    return F.concat(F.hex(F.xxhash64(*parts, *flags)), F.hex(F.xxhash64(F.lit(17), *parts, *flags)))


def _has_map(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _has_map(kind.elementType)
    return isinstance(kind, MapType) or (isinstance(kind, StructType) and any(_has_map(f.dataType) for f in kind.fields))


def whole_row_key(df: DataFrame) -> Column:
    """128 bits that identify all values of a row; maps, which cannot be hashed, count by their text."""
    return row_key(*(F.to_json(F.struct(f"`{f.name}`")) if _has_map(f.dataType) else F.col(f"`{f.name}`") for f in df.schema.fields))


def whole_row(df: DataFrame, name: str = "_doc") -> Column:
    """All columns in one struct, so that columns of any name can be carried beside an operator's own."""
    return F.struct(*(f"`{c}`" for c in df.columns)).alias(name)


def unpacked(df: DataFrame, columns: list[str], changed: dict[str, Column] | None = None, name: str = "_doc") -> list[Column]:
    """The columns of :func:`whole_row` again, some of them changed."""
    return [(changed or {}).get(c, F.col(name).getField(c)).alias(c) for c in columns]


def numbered_copies(df: DataFrame, keys: list[str], copy: str = "copy") -> DataFrame:
    """The rows of ``keys`` with a number from 0 that tells equal rows apart.

    Equal rows are counted (combined before the shuffle) and written out again, so a row that holds a
    third of the table is one counter in the shuffle.
    """
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    chunk = F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / COPY_CHUNK))
    chunks = counted.select(*keys, "_n", F.explode(chunk).alias("_chunk"))
    first = F.col("_chunk") * COPY_CHUNK
    return chunks.select(*keys, F.explode(F.sequence(first, F.least(F.col("_n"), first + COPY_CHUNK) - 1)).alias(copy))


def bounded_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one slice hold at most ``limit`` bytes, or are one text."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


class Texts:
    """The bytes of a slice of texts: ``data`` and the positions ``starts`` (one more than texts)."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        whole = pa.concat_arrays([pc.fill_null(texts.cast(pa.string()), "")])
        offsets = np.frombuffer(whole.buffers()[1], np.int32)[whole.offset:whole.offset + len(whole) + 1].astype(np.int64)
        buffer = whole.buffers()[2]
        data = np.frombuffer(buffer, np.uint8)[offsets[0]:offsets[-1]] if buffer is not None else np.zeros(0, np.uint8)
        if lower:
            data = data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)
        self.data, self.starts, self.n = data, offsets - offsets[0], len(whole)

    def count(self, flags: np.ndarray) -> np.ndarray:
        """Per text, how many bytes are flagged."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.starts[1:]] - total[self.starts[:-1]]

    def solid(self) -> np.ndarray:
        return ~((self.data == 32) | ((self.data >= 9) & (self.data <= 13)))

    def count_rare(self, *tables: np.ndarray) -> list[np.ndarray]:
        """Per text, how many bytes each table of 256 flags marks; for marks that few bytes have."""
        at = np.flatnonzero(np.logical_or.reduce(tables)[self.data])
        row, found = np.searchsorted(self.starts, at, side="right") - 1, self.data[at]
        return [np.bincount(row[table[found]], minlength=self.n) for table in tables]

    def heads(self, flags: np.ndarray) -> np.ndarray:
        """Where stretches of flagged bytes begin; a stretch ends with its text."""
        first = flags.copy()
        first[1:] &= ~flags[:-1]
        begins = self.starts[:-1][self.starts[:-1] < len(flags)]
        first[begins] = flags[begins]
        return np.flatnonzero(first)

    def runs(self, flags: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """Longest stretches of flagged bytes within each text, and the number of the text of each."""
        at = self.heads(flags)
        row = np.searchsorted(self.starts, at, side="right") - 1
        kept = np.cumsum(flags, dtype=np.int64)
        offsets = np.append(kept[at] - 1, kept[-1] if len(kept) else 0).astype(np.int32)
        buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(self.data[flags]))]
        return pa.StringArray.from_buffers(len(at), buffers[1], buffers[2]), row

    def words(self) -> tuple[pa.Array, np.ndarray]:
        return self.runs(self.solid())


def codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Small integers for equal values, and the distinct values."""
    encoded = values.dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary


def mix64(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers; different inputs stay different."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seen_before(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs (owner, value) in groups of equal pairs: all but one of each group, and the one left out.

    A scrambled key only brings equal pairs side by side; the pairs themselves are compared.
    """
    order = np.argsort(mix64(value.astype(np.uint64) ^ mix64(owner.astype(np.uint64) + np.uint64(1))))
    left, right = order[:-1], order[1:]
    same = (value[left] == value[right]) & (owner[left] == owner[right])
    again = right[same]
    leads = left[same & ~np.concatenate([[False], same[:-1]])] if len(same) else again
    return again, leads


def unit(x: np.ndarray, seed: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on the 64-bit keys and the seed only."""
    salted = x.astype(np.uint64) ^ mix64(np.array([seed + 1], np.uint64))
    return (mix64(mix64(salted)) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
