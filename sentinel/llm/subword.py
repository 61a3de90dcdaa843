"""Quality classifier on subword embeddings.

Every word, its character n-grams and every pair of neighbouring words are hashed to rows of one embedding table. A word
that follows itself also counts in one row for all words: each such pair of rare words is seen once, so its own row is not learned. A document is the mean of its rows and of ``PRIOR`` zero rows, which keeps short texts near the bias,
and a softmax layer gives the label probabilities. Table and layer are learned together by numpy stochastic
gradient descent on a bounded sample of labelled documents (``max_rows``). For scoring, the layer is
multiplied into the table: each hashed row adds one number, and a document's logit is their mean.

Defined cases: a null or empty text has no features, so its score comes from the layer's bias alone. Equal
texts get equal scores. Null labels are not used; without usable labels every score is 0.5. Other columns
are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentinel.functions.storage import cut_lineage
from sentinel.llm.common import Texts, bounded_slices, codes, mix64
from sentinel.llm.quality_rules import labelled_sample

BUCKETS = 1 << 17
GRAMS = (3, 4, 5)
PRIOR = 30.0
MAX_ENTRIES = 40_000_000  # buckets of all bags at the driver, some 500 MB
SAME = 0
_PRIME = np.uint64(0x100000001B3)


def _spelled(vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all words, each between < and >, and the lengths."""
    text = "".join(f"<{w}>" for w in vocabulary.to_pylist())
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return chars, pc.utf8_length(vocabulary).to_numpy(zero_copy_only=False).astype(np.int64) + 2


def _whole(chars: np.ndarray, place: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """One number per word, from its characters and their places."""
    return np.add.reduceat(mix64(chars + (place.astype(np.uint64) << np.uint64(24))), begins) if len(begins) else np.zeros(0, np.uint64)


def _word_hashes(vocabulary: pa.Array) -> np.ndarray:
    chars, lengths = _spelled(vocabulary)
    begins = np.cumsum(lengths) - lengths
    return mix64(_whole(chars, np.arange(len(chars)) - np.repeat(begins, lengths), begins))


def subwords(vocabulary: pa.Array, buckets: int = BUCKETS, grams: tuple[int, ...] = GRAMS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers (bucket 0 is left for doubled words) of each word and of its character n-grams (with < and > around it), and the word of each."""
    n = len(vocabulary)
    chars, lengths = _spelled(vocabulary)
    ends = np.cumsum(lengths)
    word = np.repeat(np.arange(n), lengths)
    place = np.arange(len(chars)) - np.repeat(ends - lengths, lengths)
    ids, owners = [mix64(_whole(chars, place, ends - lengths))], [np.arange(n)]
    for g in grams:
        if len(chars) < g:
            continue
        value = np.full(len(chars) - g + 1, g, np.uint64)
        for k in range(g):
            value = (value ^ chars[k:len(chars) - g + 1 + k]) * _PRIME
        inside = word[g - 1:] == word[:len(chars) - g + 1]
        ids.append(mix64(value[inside]))
        owners.append(word[:len(chars) - g + 1][inside])
    return (np.concatenate(ids) % np.uint64(buckets - 1)).astype(np.int64) + 1, np.concatenate(owners)


def word_pairs(vocabulary: pa.Array, code: np.ndarray, row: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every pair of neighbouring words of a text, and its text; ``code`` numbers the words of all texts, ``row`` their texts."""
    word = _word_hashes(vocabulary)
    together = row[1:] == row[:-1]
    first, second = word[code[:-1][together]], word[code[1:][together]]
    return (mix64(first * _PRIME + second) % np.uint64(buckets - 1)).astype(np.int64) + 1, row[1:][together]


def _doubled(code: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Flags for words (from the second on) that repeat the word before them in the same text."""
    return (code[1:] == code[:-1]) & (row[1:] == row[:-1])


def bags(texts: pa.Array, buckets: int = BUCKETS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every text the buckets of all its words' subwords, and how often each occurs."""
    words, row = Texts(texts).words()
    code, vocabulary = codes(words)
    ids, owner = subwords(vocabulary, buckets)
    order = np.argsort(owner, kind="stable")
    ids = ids[order]
    size = np.bincount(owner, minlength=len(vocabulary))
    heads = np.concatenate([[0], np.cumsum(size)])
    doubled = np.bincount(row[1:][_doubled(code, row)], minlength=len(texts))
    pairs, pair_row = word_pairs(vocabulary, code, row, buckets)
    pair_cuts = np.searchsorted(pair_row, np.arange(len(texts) + 1))
    cuts = np.searchsorted(row, np.arange(len(texts) + 1))
    out = []
    for i in range(len(texts)):
        mine, times = np.unique(code[cuts[i]:cuts[i + 1]], return_counts=True)
        at = np.repeat(heads[mine] - np.concatenate([[0], np.cumsum(size[mine])])[:-1], size[mine]) + np.arange(size[mine].sum())
        total = np.bincount(ids[at], np.repeat(times, size[mine]), buckets) if len(at) else np.zeros(buckets)
        total[SAME] += doubled[i]
        total += np.bincount(pairs[pair_cuts[i]:pair_cuts[i + 1]], minlength=buckets)
        found = np.flatnonzero(total)
        out.append((found, total[found]))
    return out


@dataclass(frozen=True)
class Subword:
    """Folded model: a document's logit is bias plus the mean of ``weight`` over its subwords."""

    weight: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        words, row = Texts(texts).words()
        code, vocabulary = codes(words)
        ids, owner = subwords(vocabulary, len(self.weight))
        total = np.bincount(owner, self.weight[ids], len(vocabulary)) if len(ids) else np.zeros(0)
        size = np.bincount(owner, minlength=len(vocabulary)).astype(float)
        n = len(texts)
        doubled = np.bincount(row[1:][_doubled(code, row)], minlength=n)
        pairs, pair_row = word_pairs(vocabulary, code, row, len(self.weight))
        added = np.bincount(row, total[code], n) + np.bincount(pair_row, self.weight[pairs], n) + doubled * self.weight[SAME]
        mean = added / (np.bincount(row, size[code], n) + np.bincount(pair_row, minlength=n) + doubled + PRIOR)
        return 1 / (1 + np.exp(-np.clip(self.bias + mean, -700, 700)))


def train(documents: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, buckets: int = BUCKETS, width: int = 16,
          epochs: int = 5, rate: float = 0.5, seed: int = 5) -> Subword:
    """Stochastic gradient descent, one document a step, with a rate that falls to zero."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / width, 1 / width, (buckets, width)).astype(np.float32)
    layer, bias = np.zeros((width, 2), np.float32), np.zeros(2, np.float32)
    if not len(y):
        return Subword(np.zeros(buckets), 0.0)
    bias[1] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    shares = [(c / (c.sum(dtype=float) + PRIOR)).astype(np.float32) for _, c in documents]
    step, steps = 0, epochs * len(y)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            ids, share = documents[i][0], shares[i]
            rows = table[ids]
            hidden = share @ rows
            logits = hidden @ layer + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[int(y[i])] -= 1
            speed = np.float32(rate * (1 - step / steps))
            # The mean over many subwords gives each a tiny gradient; scaled by their effective number, rare marks can be learned.
            spread = np.float32(min(1 / max(float(share @ share), 1e-9), 50.0))
            table[ids] = rows - np.outer(speed * spread * share, layer @ p)
            layer -= speed * np.outer(hidden, p)
            bias -= 0.1 * speed * p
            step += 1
    return Subword((table @ (layer[:, 1] - layer[:, 0])).astype(float), float(bias[1] - bias[0]))


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """crc32 of the id as text is divisible by 5; a null id counts as the text null."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("null"))) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 4_000, **settings) -> Subword:
    """Learn from at most ``max_rows`` labelled documents that are not held out; only their bags come to the driver, those with the smallest
    hashes up to ``MAX_ENTRIES`` buckets in all."""
    sample = labelled_sample(docs, labels, label, max_rows, ~held_out())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bounded_slices(batches, "text"):
            found = bags(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.string()), part.column("_key"), part.column("_y"), pa.array([i.astype(np.int32) for i, _ in found], pa.list_(pa.int32())),
                 pa.array([c.astype(np.float32) for _, c in found], pa.list_(pa.float32()))], ["doc_id", "_key", "_y", "ids", "counts"])

    made = cut_lineage(sample.mapInArrow(rows, "doc_id string, _key string, _y int, ids array<int>, counts array<float>"))
    sizes = made.select("_key", F.size("ids").alias("n")).orderBy(F.xxhash64("_key"), "_key").toArrow()  # one number per sampled row
    fits = np.searchsorted(np.cumsum(sizes.column("n").to_numpy()), MAX_ENTRIES, side="right")
    if fits < sizes.num_rows:
        made = made.where(F.col("_key").isin(sizes.column("_key").slice(0, int(fits)).to_pylist()))
    table = made.toArrow().sort_by([("doc_id", "ascending"), ("_y", "ascending"), ("_key", "ascending")])
    found = list(zip((x.values.to_numpy() for x in table.column("ids")), (x.values.to_numpy() for x in table.column("counts"))))
    return train(found, table.column("_y").to_numpy(), **settings)


def score(docs: DataFrame, model: Subword, cut: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bounded_slices(batches, "text"):
            values = model.score(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(values)], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
