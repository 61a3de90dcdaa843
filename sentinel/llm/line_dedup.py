"""Lines that many documents share are dropped: explode, hash, count documents per hash, reassemble by position.

A line's key is the line without ASCII blanks at both ends and with A to Z in lower case. Long keys become 128-bit hashes. Hashes are
counted per distinct doc_id, combined before the shuffle, and a hash found in enough documents keeps its lines only
in the largest doc_id that holds it. The dropped positions of each text come back to it, and its other lines are joined in
their order. Only hashes and positions are shuffled before that; texts move once.

Defined cases: a null or empty text is one empty line, which is too short to be dropped. A null doc_id is one document, smaller than all others;
if a line's largest doc_id is null, the line is held by one document only and stays. Rows with equal doc_id are one document, each keeps or
loses a line like the others. Other columns pass through :func:`drop_common_lines`. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentinel.functions.storage import cut_lineage
from sentinel.llm.keyed import join_by_key, let

# The characters that are stripped, and the letters that are lowered.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_DOCS = 20, 3
_HASH, _ROW = ["_h1", "_h2"], ["_r1", "_r2"]


def _hashed(*parts: Column) -> list[Column]:
    return [F.xxhash64(*parts), F.xxhash64(F.lit(29), *parts)]


def _row_hash() -> list[Column]:
    named = [F.col("doc_id"), F.col("text")]
    return [c.alias(n) for c, n in zip(_hashed(*named, *(c.isNull() for c in named)), _ROW)]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def long_lines(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """One row per line with a long key: doc_id, the hash of the row, the position of the line, and the hash of its key."""
    lowered = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    lines = docs.select("doc_id", *_row_hash(), F.posexplode(F.split(lowered, "\n", -1)).alias("_pos", "_line"))
    key = F.btrim("_line", F.lit(BLANKS))
    keyed = lines.select("doc_id", *_ROW, "_pos", key.alias("_key")).where(F.length("_key") >= least_length)
    return keyed.select("doc_id", *_ROW, "_pos", *(c.alias(n) for c, n in zip(_hashed(F.col("_key")), _HASH)))


def common_lines(lines: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Hashes found in at least ``least_docs`` documents: the largest doc_id (``_keeper``) and the number of lines (``_held``)."""
    per_doc = lines.groupBy(*_HASH, "doc_id").agg(F.count(F.lit(1)).alias("_n"))
    whole = per_doc.groupBy(*_HASH).agg(F.count(F.lit(1)).alias("_docs"), F.max("doc_id").alias("_keeper"), F.sum("_n").alias("_held"))
    return whole.where(F.col("_docs") >= least_docs).drop("_docs")


def dropped_positions(docs: DataFrame, least_length: int = LEAST_LENGTH, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Per row hash the positions (from 0) of the lines that go."""
    lines = long_lines(docs, least_length)
    shared = cut_lineage(common_lines(lines, least_docs))
    gone = join_by_key(lines, shared, _HASH, "_held").where(~F.col("doc_id").eqNullSafe(F.col("_keeper")))
    return gone.groupBy(*_ROW).agg(F.collect_set("_pos").alias("_gone"))


def _kept(text: Column, gone: Column) -> Column:
    def rest(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.array_join(F.transform(stay, lambda i: F.element_at(lines, i + 1)), "\n")

    return F.when(gone.isNull(), text).otherwise(let(_lines(text), rest))


def drop_common_lines(docs: DataFrame, least_length: int = LEAST_LENGTH, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``docs`` without the lines that are kept elsewhere; all other columns stay as they are."""
    rows = docs.select(F.struct("*").alias("_doc"), *_row_hash())
    joined = rows.join(dropped_positions(docs, least_length, least_docs), _ROW, "left")
    text = _kept(F.col("_doc.text"), F.col("_gone"))
    return joined.select(*(text.alias(c) if c == "text" else F.col("_doc").getField(c).alias(c) for c in docs.columns))


def report(docs: DataFrame, least_length: int = LEAST_LENGTH, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped, and text without the dropped lines, for every row."""
    rows = docs.select("doc_id", "text", *_row_hash())
    joined = rows.join(dropped_positions(docs, least_length, least_docs), _ROW, "left")
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return joined.select("doc_id", F.coalesce(n_lines, F.lit(1)).cast("long").alias("n_lines"),
                         F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"), _kept(F.col("text"), F.col("_gone")).alias("text"))
