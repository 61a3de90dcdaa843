"""Quality rules: boosted trees over document statistics, with monotonic constraints.

The trees are fitted by numpy on a bounded sample of labelled documents (``max_rows``, the smallest
keyed hashes), flattened into node arrays, and every document is scored in Arrow tasks.

Defined cases: a null or empty text has no words, fails the base rules and is not kept. Equal rows get
equal results. Labels that are null are not used; without any usable label, or with one class only,
every document gets that class's rate. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentinel.llm.common import Texts, bounded_slices, codes, row_key, seen_before

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share",
            "digit_share", "punct_share", "distinct_share", "line_words", "end_marks")
#: +1: more of it may only raise the quality, -1: only lower it, 0: free.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1, "punct_share": -1}
_SYMBOL, _UPPER, _DIGIT, _PUNCT = (np.zeros(256, bool) for _ in range(4))
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[65:91] = True
_DIGIT[48:58] = True
_PUNCT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def statistics(texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Base counts and the feature matrix of a slice of texts."""
    t = Texts(texts)
    solid = t.solid()
    words, row = t.runs(solid)
    n = np.bincount(row, minlength=t.n)
    lines, line_row = t.runs(t.data != 10)
    has_word = np.logical_or.reduceat(solid, t.heads(t.data != 10)) if len(lines) else np.zeros(0, bool)
    lines, line_row = lines.filter(pa.array(has_word)), line_row[has_word]
    n_lines = np.bincount(line_row, minlength=t.n)
    line_code, _ = codes(lines)
    different = _distinct_per_row(line_row, line_code, t.n)
    code, vocabulary = codes(words)
    symbols, upper, digits, punct = t.count_rare(_SYMBOL, _UPPER, _DIGIT, _PUNCT)
    base = {
        "n_words": n,
        "word_chars": t.count(solid & ((t.data & 0xC0) != 0x80)),
        "n_symbols": symbols,
        "n_dup_lines": n_lines - different,
        "n_repeat_words": _repeated(code, row, len(vocabulary), t.n),
    }
    chars = np.maximum(base["word_chars"], 1)
    marks = np.bincount(line_row, weights=_ends_in_mark(lines), minlength=t.n)
    words_or_1, lines_or_1 = np.maximum(n, 1), np.maximum(n_lines, 1)
    matrix = np.column_stack([
        np.log1p(n), base["word_chars"] / words_or_1, base["n_symbols"] / chars, base["n_dup_lines"] / lines_or_1,
        base["n_repeat_words"] / words_or_1, upper / chars, digits / chars,
        punct / chars, _distinct_per_row(row, code, t.n) / words_or_1, n / lines_or_1, marks / lines_or_1,
    ])
    return {k: v.astype(np.int64) for k, v in base.items()}, matrix


def _distinct_per_row(row: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    if not len(row):
        return np.zeros(n, np.int64)
    width = int(code.max()) + 1
    key = np.sort(row * width + code)
    return np.bincount(key[np.concatenate([[True], key[1:] != key[:-1]])] // width, minlength=n)


def _repeated(code: np.ndarray, row: np.ndarray, width: int, n: int) -> np.ndarray:
    """Words inside three-word windows that occur at least twice in their text."""
    if len(code) < 3:
        return np.zeros(n, np.int64)
    at = np.flatnonzero(row[2:] == row[:-2])
    if width < 1 << 21:
        window = (code[at] << 42) | (code[at + 1] << 21) | code[at + 2]
    else:
        pair, _ = codes(pa.array(code[at] * width + code[at + 1]))
        window, _ = codes(pa.array(pair * width + code[at + 2]))
    again = at[np.concatenate(seen_before(row[at], window))]
    covered = np.zeros(len(code), bool)
    for step in range(3):
        covered[again + step] = True
    return np.bincount(row[covered], minlength=n)


def _ends_in_mark(lines: pa.Array) -> np.ndarray:
    if not len(lines):
        return np.zeros(0)
    offsets = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset:lines.offset + len(lines) + 1]
    last = np.frombuffer(lines.buffers()[2], np.uint8)[offsets[1:] - 1]
    return np.isin(last, list(b".!?\"'")).astype(float)


@dataclass(frozen=True)
class Trees:
    """All trees in flat arrays: node i goes to left[i] if x[feature[i]] <= threshold[i], else to right[i]; leaves point at themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row, all trees at once."""
        if not len(self.roots):
            return np.full(len(x), 1 / (1 + np.exp(-self.start)))
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.start + self.value[node].sum(axis=1))))


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2,
              bins: int = 64, ridge: float = 1.0, least: float = 5.0) -> Trees:
    """Logistic boosting on binned features. A split on a constrained feature must order its two sides, and their
    mean bounds everything below, so that the whole model is monotone in that feature."""
    rate_of_1 = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    start = float(np.log(rate_of_1 / (1 - rate_of_1)))
    nodes: list[list] = []
    roots: list[int] = []
    if len(y) and 0 < y.mean() < 1:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
        logit = np.full(len(y), start)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-logit))
            roots.append(_grow(nodes, binned, edges, p - y, p * (1 - p), np.arange(len(y)), monotone, depth, rate,
                               ridge, least, -np.inf, np.inf, logit))
    flat = list(zip(*nodes)) if nodes else [()] * 5
    return Trees(np.array(flat[0], np.int64), np.array(flat[1], float), np.array(flat[2], np.int64),
                 np.array(flat[3], np.int64), np.array(flat[4], float), np.array(roots, np.int64), depth, start)


def _grow(nodes, binned, edges, grad, hess, rows, monotone, depth, rate, ridge, least, low, high, logit) -> int:
    me = len(nodes)
    g, h = grad[rows].sum(), hess[rows].sum()
    weight = float(np.clip(-g / (h + ridge), low, high))
    nodes.append([0, np.inf, me, me, rate * weight])
    best = (1e-6, -1, 0, 0.0, 0.0)
    for j, cuts in enumerate(edges if depth else ()):
        if not len(cuts):
            continue
        bin_of = binned[rows, j]
        gl = np.cumsum(np.bincount(bin_of, grad[rows], len(cuts) + 1))[:-1]
        hl = np.cumsum(np.bincount(bin_of, hess[rows], len(cuts) + 1))[:-1]
        wl = np.clip(-gl / (hl + ridge), low, high)
        wr = np.clip(-(g - gl) / (h - hl + ridge), low, high)
        gain = (-(gl * wl + (hl + ridge) * wl**2 / 2) - ((g - gl) * wr + (h - hl + ridge) * wr**2 / 2)
                + (g * weight + (h + ridge) * weight**2 / 2))
        allowed = (hl >= least / 4) & (h - hl >= least / 4) & (monotone[j] * (wr - wl) >= 0)
        gain = np.where(allowed, gain, -np.inf)
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (float(gain[k]), j, k, float(wl[k]), float(wr[k]))
    _, j, k, wl, wr = best
    if j < 0:
        logit[rows] += rate * weight
        return me
    goes_left = binned[rows, j] <= k
    middle = (wl + wr) / 2
    bounds = ((low, high), (low, high))
    if monotone[j] > 0:
        bounds = ((low, middle), (middle, high))
    elif monotone[j] < 0:
        bounds = ((middle, high), (low, middle))
    nodes[me][:2] = [j, float(edges[j][k])]
    nodes[me][2] = _grow(nodes, binned, edges, grad, hess, rows[goes_left], monotone, depth - 1, rate, ridge, least, *bounds[0], logit)
    nodes[me][3] = _grow(nodes, binned, edges, grad, hess, rows[~goes_left], monotone, depth - 1, rate, ridge, least, *bounds[1], logit)
    return me


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, allowed: Column | None = None) -> DataFrame:
    """Distinct texts of labelled documents with their labels (doc_id, text, ``_y`` and the key of the row, ``_key``).

    Of the labels those with the smallest keyed hashes are taken, and so are the rows that they belong to: at most ``max_rows`` of either, however
    often an id occurs in ``docs``. A row with two labels is listed with each.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    if allowed is not None:
        known = known.where(allowed)
    picked = known.select("doc_id", F.col(label).cast("int").alias("_y")).orderBy(F.xxhash64("doc_id"), "doc_id", "_y").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").withColumn("_key", row_key("doc_id", "text"))
    chosen = rows.select("_key").distinct().orderBy(F.xxhash64("_key"), "_key").limit(max_rows)
    return rows.join(F.broadcast(chosen), "_key", "left_semi").dropDuplicates(["_key", "_y"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 20_000, **settings) -> Trees:
    """Fit on the statistics of the sample; only these statistics and labels come to the driver."""
    sample = labelled_sample(docs, labels, label, max_rows)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bounded_slices(batches, "text"):
            _, matrix = statistics(part.column("text"))
            yield pa.RecordBatch.from_arrays([*map(pa.array, matrix.T), part.column("_y")], [*FEATURES, "_y"])

    table = sample.mapInArrow(rows, ", ".join(f"{c} double" for c in FEATURES) + ", _y int").toPandas()
    table = table.sort_values([*FEATURES, "_y"])
    return fit_trees(table[list(FEATURES)].to_numpy(), table["_y"].to_numpy(float), np.array([MONOTONE.get(c, 0) for c in FEATURES]), **settings)


def judge(docs: DataFrame, trees: Trees, least_score: float = 0.5, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry``, the base counts, base_failed, score and kept for every row of ``docs``.

    base_failed: fewer than 50 words, or over half of the words in repeated windows. kept: not
    base_failed and a score of at least ``least_score``.
    """
    kept_fields = [f for f in docs.select(*carry).schema.fields]
    names = [f.name for f in kept_fields] + [*BASE, "base_failed", "score", "kept"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bounded_slices(batches, "text"):
            base, matrix = statistics(part.column("text"))
            failed = (base["n_words"] < 50) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
            score = trees.score(matrix)
            out = [base[c] for c in BASE] + [failed, score, ~failed & (score >= least_score)]
            yield pa.RecordBatch.from_arrays([part.column(f.name) for f in kept_fields] + [pa.array(v) for v in out], names)

    schema = docs.select(*carry).schema
    for c in BASE:
        schema = schema.add(c, "long")
    schema = schema.add("base_failed", "boolean").add("score", "double").add("kept", "boolean")
    return docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(rows, schema)


def keep(docs: DataFrame, trees: Trees, least_score: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bounded_slices(batches, "text"):
            base, matrix = statistics(part.column("text"))
            failed = (base["n_words"] < 50) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
            yield part.filter(pa.array(~failed & (trees.score(matrix) >= least_score)))

    return docs.mapInArrow(rows, docs.schema)
