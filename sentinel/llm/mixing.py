"""Mixing sources to target weights by pivotal dependent rounding.

A source's share of the mix fixes how often each of its documents should occur: a whole number of copies and a
fraction. Fractions are rounded in pairs. In a pair, words move from one document to the other until one of the
two fractions is 0 or 1, in a random direction whose odds keep every expectation. Words are only moved, so after all
pairs the words taken from a source differ from its target by less than one document.

Blocks of documents are rounded in parallel; each leaves at most one undecided document, and the undecided of
many blocks are rounded together, level by level, until one per source is left. All draws depend on the rows, so
reruns agree.

Defined cases: a null text has size 0. Documents of size 0 take a keyed coin each and contribute no words. A null source is a source,
ordered last. Equal rows are numbered and rounded on their own. A table without words takes nothing. Other columns
pass through ``mixed``. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sentinel.functions.storage import cut_lineage
from sentinel.llm.common import n_words, numbered_copies, unit, unpacked, whole_row, whole_row_key

WEIGHTS = (3.0, 1.0, 2.0)
BLOCK_ROWS = 4096
FAN_IN = 64


def targets(sizes: DataFrame, share: float, most: float) -> DataFrame:
    """Target words per source from (source, weight, source_size): ``share`` of all words by weight, at most ``most`` times a source.

    Sources fill up in the order of size over weight. With the first ones at their limit, the rest share what is left
    by weight; the right number of full sources is the first for which no other exceeds its limit.
    """
    ordered = W.orderBy(F.col("source_size") / F.col("weight"), "weight", F.col("source").asc_nulls_last())
    done = ordered.rowsBetween(W.unboundedPreceding, -1)
    left = ordered.rowsBetween(0, W.unboundedFollowing)
    ranked = sizes.withColumn("_full", F.coalesce(F.sum("source_size").over(done), F.lit(0)) * most).withColumn(
        "_weights", F.sum("weight").over(left)).withColumn("_all", F.sum("source_size").over(W.partitionBy()))
    level = (F.col("_all") * share - F.col("_full")) / F.col("_weights")
    fits = level * F.col("weight") <= F.col("source_size") * most
    ranked = ranked.withColumn("_level", F.when(fits, level))
    # The level of the first source that is not full holds for all later ones.
    ranked = ranked.withColumn("_level", F.first("_level", ignorenulls=True).over(ordered.rowsBetween(W.unboundedPreceding, 0)))
    return ranked.select("source", "source_size", F.least(
        F.coalesce(F.col("_level") * F.col("weight"), F.col("source_size") * most), F.col("source_size") * most).cast("double").alias("target"))


def cycled_weights(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """source, source_size and weight: weights repeat over the sources in order, null last."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    return sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))


def pivot_block(keys: np.ndarray, size: np.ndarray, fraction: np.ndarray, level: int) -> np.ndarray:
    """Rounded fractions of one block, in key order; at most one stays between 0 and 1."""
    out = np.asarray(fraction, float).copy()
    draws = unit(keys, level)
    order = np.argsort(keys, kind="stable")
    hold = -1
    for i in order[(out[order] > 0) & (out[order] < 1)].tolist():
        if size[i] == 0:
            out[i] = float(draws[i] < out[i])
            continue
        if hold < 0:
            hold = i
            continue
        up = min((1 - out[hold]) * size[hold], out[i] * size[i])
        down = min(out[hold] * size[hold], (1 - out[i]) * size[i])
        rise = draws[i] * (up + down) < down
        moved = up if rise else -down
        a, b = out[hold] + moved / size[hold], out[i] - moved / size[i]
        # Whichever reached its bound is set to it exactly.
        if rise:
            first_done = (1 - out[hold]) * size[hold] <= out[i] * size[i]
            a, b = (1.0, b) if first_done else (a, 0.0)
        else:
            first_done = out[hold] * size[hold] <= (1 - out[i]) * size[i]
            a, b = (0.0, b) if first_done else (a, 1.0)
        out[hold], out[i] = min(max(a, 0.0), 1.0), min(max(b, 0.0), 1.0)
        hold = next((j for j in ((i, hold) if first_done else (hold, i)) if 0 < out[j] < 1), -1)
    return out


def _step(level: int, last: bool):
    """One level for one block; the last level also draws for the document that is left."""

    def step(table: pa.Table) -> pa.Table:
        keys = table.column("_h").to_numpy().view(np.uint64)
        out = pivot_block(keys, table.column("size").to_numpy(), table.column("fraction").to_numpy(), level)
        if last:
            out = np.where((out > 0) & (out < 1), unit(keys, level + 1000) < out, out)
        return table.set_column(table.schema.get_field_index("fraction"), "fraction", pa.array(out, pa.float64()))

    return step


def rounded(rows: DataFrame, total: int, block_rows: int = BLOCK_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """Rows (source, size, fraction, _h and others) with ``fraction`` rounded to 0 or 1 through the reduction tree."""
    blocks, level = max(-(-total // block_rows), 1), 0
    current, decided = rows.withColumn("_block", F.pmod("_h", F.lit(blocks))), []
    columns = ", ".join(f"`{c}` {t}" for c, t in current.dtypes)
    while True:
        last = blocks == 1
        done = cut_lineage(current.groupBy("source", "_block").applyInArrow(_step(level, last), columns))
        open_row = (F.col("fraction") > 0) & (F.col("fraction") < 1)
        decided.append(done if last else done.where(~open_row))
        if last:
            break
        blocks, level = max(blocks // fan_in, 1), level + 1
        current = done.where(open_row).withColumn("_block", F.pmod("_h", F.lit(blocks)))
    out = decided[0]
    for part in decided[1:]:
        out = out.union(part)
    return out.drop("_block")


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """doc_id, size, source_size, target (of the source), taken (words) and copies for every row of ``docs``, and its row key."""
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), whole_row_key(docs).alias("key"))
    rows = cut_lineage(numbered_copies(sized, ["doc_id", "source", "size", "key"]))
    plan = targets(cycled_weights(rows, weights), share, most)
    copies = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(most))).otherwise(0.0)
    same = F.col("source").eqNullSafe(F.col("_source"))
    planned = rows.join(plan.withColumnRenamed("source", "_source"), same).drop("_source").withColumn("_p", copies).withColumn(
        "whole", F.floor("_p")).withColumn("fraction", F.col("_p") - F.col("whole")).withColumn("_h", F.xxhash64("key", "copy")).drop("_p")
    out = rounded(planned, rows.count())
    number = (F.col("whole") + F.col("fraction")).cast("long")
    return out.select("doc_id", "size", "source_size", "target", (number * F.col("size")).alias("taken"), number.alias("copies"), "key")


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    taken = mix(docs, **settings).groupBy("key").agg(F.sum("copies").alias("_copies")).where("_copies > 0")
    once = docs.select(whole_row_key(docs).alias("_key"), whole_row(docs)).groupBy("_key").agg(F.first("_doc").alias("_doc"))
    found = once.join(taken.withColumnRenamed("key", "_key"), "_key")
    each = found.select("_doc", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_number"))
    return each.select(*unpacked(each, docs.columns))
