"""Maximal periodic runs of words, found by block convolution at dyadic scales.

A run of period q with at least four periods holds a whole block of B words (B the power of two with B <= q < 2B, block
starts at multiples of B) that is repeated q words later. At every scale each block is compared with all distances of
[B, 2B) at once: the sum of squared differences of word numbers is a correlation plus sums of squares, computed by a
number-theoretic transform, and a distance where it is zero is an occurrence. Distances seed extensions to the left and to
the right; the words themselves are compared there, so a sum that is zero modulo the prime only cannot add a run.
Blocks are left out only where they cannot matter: a word of the block does not return within 2B words, or the whole window lies in
a known run of smaller period (then every occurrence is a multiple of that period).

The texts of a slice are laid end to end with a word between them that never returns, so all texts of a slice share the
transforms. A text is the unit of work; a slice holds a few megabytes or one text.

Defined cases: a null or empty text has no words, no run and the hash of the empty text. A null doc_id is never altered by
:func:`repeat_tails`. Equal rows get equal results. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sentinel.llm.common import bounded_slices

# A prime with many powers of two in P - 1, and a generator of its units. Products of residues fit 64 bits.
PRIME, GENERATOR = 3 * 2**30 + 1, 5
LEAST_WORDS, LEAST_PERIODS = 6, 4
_P = np.uint64(PRIME)
_BATCH = 1 << 17

Tail = Callable[[object, int], tuple[int, int] | None]


@lru_cache(maxsize=64)
def _powers(root: int, n: int) -> np.ndarray:
    """root**0 .. root**(n - 1) modulo the prime."""
    out = np.ones(n, np.uint64)
    have = 1
    while have < n:
        take = min(have, n - have)
        out[have:have + take] = out[:take] * np.uint64(pow(root, have, PRIME)) % _P
        have += take
    return out


def ntt(x: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Transform of the rows of ``x`` (residues; the width is a power of two)."""
    rows, n = x.shape
    root = pow(GENERATOR, (PRIME - 1) // n, PRIME)
    root = pow(root, PRIME - 2, PRIME) if inverse else root
    half, step = n // 2, 1
    while half:
        pair = x.reshape(rows, 2, half, step)
        low, high = pair[:, 0], pair[:, 1]
        turn = _powers(pow(root, step, PRIME), half)[:, None]
        out = np.empty((rows, half, 2, step), np.uint64)
        out[:, :, 0] = (low + high) % _P
        out[:, :, 1] = (low + (_P - high)) % _P * turn % _P
        x, half, step = out.reshape(rows, n), half // 2, step * 2
    return x * np.uint64(pow(n, PRIME - 2, PRIME)) % _P if inverse else x


def occurrences(values: np.ndarray, starts: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (start, distance in [block, 2 * block)) where the sum of squared differences vanishes modulo the prime."""
    n = len(values)
    padded = np.concatenate([values.astype(np.uint64) % _P, np.zeros(3 * block, np.uint64)])
    squares = np.concatenate([np.zeros(1, np.uint64), np.cumsum(padded * padded % _P)])
    at, distances = [], []
    per_batch = max(_BATCH // (2 * block), 1)
    inside, shift = np.arange(block), np.arange(block, 2 * block)
    for first in range(0, len(starts), per_batch):
        s = starts[first:first + per_batch]
        pattern = np.zeros((len(s), 2 * block), np.uint64)
        pattern[:, -inside] = padded[s[:, None] + inside]
        window = padded[(s + block)[:, None] + np.arange(2 * block)]
        both = ntt(ntt(pattern) * ntt(window) % _P, inverse=True)[:, :block]
        own = (squares[s + block] - squares[s])[:, None]
        ends = s[:, None] + shift
        other = squares[ends + block] - squares[ends]
        zero = ((own + other) % _P + (_P - both * np.uint64(2) % _P)) % _P == 0
        row, column = np.nonzero(zero & (ends + block <= n))
        at.append(s[row])
        distances.append(column + block)
    return (np.concatenate(at), np.concatenate(distances)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _extend(values: np.ndarray, start: int, distance: int) -> tuple[int, int]:
    """The longest stretch [l, r) around start in which every word equals the one ``distance`` later."""
    right, size, last = start, 64, len(values) - distance
    while right < last:
        stop = min(right + size, last)
        differs = np.flatnonzero(values[right:stop] != values[right + distance:stop + distance])
        if len(differs):
            right += int(differs[0])
            break
        right, size = stop, size * 2
    left, size = start, 64
    while left > 0:
        stop = max(left - size, 0)
        differs = np.flatnonzero(values[stop:left] != values[stop + distance:left + distance])
        if len(differs):
            left = stop + int(differs[-1]) + 1
            break
        left, size = stop, size * 2
    return left, right


def find_runs(values: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs of a sequence of whole numbers, in order."""
    n = len(values)
    order = np.argsort(values, kind="stable")
    returns = np.full(n, n, np.int64)
    same = values[order[:-1]] == values[order[1:]]
    returns[order[:-1][same]] = order[1:][same] - order[:-1][same]
    runs: list[tuple[int, int, int]] = []
    reach = np.zeros(n, np.int64)  # how far known runs that start here or earlier go
    block = 1
    while LEAST_PERIODS * block <= n:
        usable = n // block * block
        starts = np.flatnonzero(returns[:usable].reshape(-1, block).max(axis=1) < 2 * block) * block
        starts = starts[reach[starts] < np.minimum(starts + 3 * block - 1, n)]
        at, distance = occurrences(values, starts, block)
        fresh = reach[at] < at + distance + block
        at, distance = at[fresh], distance[fresh]
        ordered = np.lexsort((at, distance))
        found, done, last = [], -1, 0
        for s, d in zip(at[ordered].tolist(), distance[ordered].tolist()):
            if d == last and s < done:
                continue
            left, right = _extend(values, s, d)
            last, done = d, max(right, s + 1)
            if right - left + d >= max(LEAST_WORDS, LEAST_PERIODS * d) and reach[left] < right + d:
                found.append((left, right + d - left, d))
        if found:
            runs += found
            for left, length, _ in found:
                reach[left] = max(reach[left], left + length)
            reach = np.maximum.accumulate(reach)
        block *= 2
    return sorted(runs, key=lambda r: (r[0], r[2]))


def repeat_tails(doc_id: object, n: int) -> tuple[int, int] | None:
    """Of one document in ten, by the checksum of its id, where its words begin to repeat and at what period."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    a, g = h // 10 % n, h // 10
    return a, 1 + (n - a) // (3 + g % 8)


def _words(text: str | None, doc_id: object, tail: Tail | None) -> list[bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").split()  # bytes.split() knows exactly the blanks 0x20 and 0x09 to 0x0D
    change = tail(doc_id, len(words)) if tail else None
    if change:
        a, p = change
        words[a:] = (words[a:a + p] * -(-(len(words) - a) // p))[:len(words) - a]
    return words


def _slice_rows(ids: list, texts: list, tail: Tail | None) -> dict[str, list]:
    docs = [_words(t, i, tail) for i, t in zip(ids, texts)]
    numbers: list[int] = []
    begins, used = [], 0
    for words in docs:
        known: dict[bytes, int] = {}
        begins.append(len(numbers))
        numbers += [known.setdefault(w, used + len(known)) for w in words]
        used += len(known) + 1
        numbers.append(used - 1)  # the word that never returns
    edges = np.array(begins, np.int64)
    of_doc: dict[int, list[tuple[int, int, int]]] = {}
    for start, length, period in find_runs(np.array(numbers, np.int64)):
        doc = int(np.searchsorted(edges, start, side="right")) - 1
        of_doc.setdefault(doc, []).append((start - begins[doc], length, period))
    out: dict[str, list] = {"doc_id": ids, "n_words": [len(w) for w in docs], "runs": [], "collapsed": []}
    for number, words in enumerate(docs):
        runs = of_doc.get(number, [])
        if runs:
            marks = np.zeros(len(words) + 1, np.int64)
            for start, length, period in runs:
                marks[start + period] += 1
                marks[start + length] -= 1
            words = [words[i] for i in np.flatnonzero(np.cumsum(marks[:-1]) == 0)]
        out["runs"].append([{"start": s, "length": n, "period": q} for s, n, q in runs])
        out["collapsed"].append(b" ".join(words))
    return out


def _scan(docs: DataFrame, tail: Tail | None, finish: Callable[[dict[str, list]], dict[str, list]], columns: str) -> DataFrame:
    id_type = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "text")
    names = ["doc_id", *(c.split(" ", 1)[0] for c in columns.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bounded_slices(batches, "text"):
            found = _slice_rows(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), tail)
            made = finish(found)
            made["doc_id"] = part.column("doc_id")
            yield pa.RecordBatch.from_arrays([made[c] if isinstance(made[c], pa.Array) else pa.array(made[c]) for c in names], names)

    return rows.mapInArrow(run, f"doc_id {id_type}, {columns}")


def runs(docs: DataFrame, tail: Tail | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length and period of every run, by start, then period) and collapsed, the text without the repeats."""
    def finish(found: dict[str, list]) -> dict:
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        return {"n_words": pa.array(found["n_words"], pa.int64()), "runs": pa.array(found["runs"], kind),
                "collapsed": pa.array([c.decode("utf-8", "surrogatepass") for c in found["collapsed"]], pa.string())}

    return _scan(docs, tail, finish, "n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def report(docs: DataFrame, tail: Tail | None = None) -> DataFrame:
    """Per row the number of runs, the longest one (ties: smallest start, then period), and digests of all runs and of the collapsed text."""
    def finish(found: dict[str, list]) -> dict:
        longest = [max(rs, key=lambda r: (r["length"], -r["start"], -r["period"]), default=None) for rs in found["runs"]]
        of = lambda field: pa.array([r and r[field] for r in longest], pa.int64())
        lines = ["".join(f"{r['start']},{r['length']},{r['period']}\n" for r in rs) for rs in found["runs"]]
        return {"n_runs": pa.array(map(len, found["runs"]), pa.int64()), "start": of("start"), "length": of("length"), "period": of("period"),
                "exponent_milli": pa.array([r and 1000 * r["length"] // r["period"] for r in longest], pa.int64()),
                "runs_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in lines],
                "collapsed_sha256": [hashlib.sha256(c).hexdigest() for c in found["collapsed"]]}

    return _scan(docs, tail, finish, "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
