"""Order statistics without sorting a whole group in one task.

The operators first count rows per cell of an order-preserving key and then look only at the
cells that matter, so a group that holds a third of the table is never collected or sorted whole.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentinel.functions.joins import join_null_safe
from sentinel.functions.storage import cut_lineage, small_table
from sentinel.operators import curves

RANK_CELLS = 1 << 14


# ---------------------------------------------------------------------------
# rows among the k smallest of their stratum
# ---------------------------------------------------------------------------

def mark_smallest(
    df: DataFrame,
    strata: Sequence[str],
    draw: str,
    key: str,
    quotas: Mapping[str, Callable[[Column], Column]],
) -> DataFrame:
    """Add a boolean per quota: is the row among the first k of its stratum by (draw, key)?

    ``draw`` is a uniform number in [0, 1); ``quotas`` maps a new column name to a function from
    the stratum's row count to k, in which the strata columns can be used. NULL is a stratum of its own. The draws are counted per cell, the cell in which rank k falls is
    ranked exactly (1/16384 of a stratum), and the (draw, key) found there becomes a threshold. The
    rows themselves are never shuffled.
    """
    if not strata:
        one = mark_smallest(df.withColumn("_all", F.lit(0)), ["_all"], draw, key, quotas)
        return one.drop("_all")
    strata = list(strata)
    joined = join_null_safe(df, smallest_cuts(df, strata, draw, key, quotas), strata, "left")
    flags = [
        F.coalesce(F.struct(F.col(draw).alias("_u"), F.col(key).alias("_k")) <= F.col(f"_cut_{name}"),
                   F.lit(False)).alias(name)
        for name in quotas
    ]
    return joined.select(*df.columns, *flags)


def smallest_cuts(df: DataFrame, strata: Sequence[str], draw: str, key: str, quotas: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """(strata, a struct ``_cut_<name>`` of ``_u`` and ``_k`` per quota): the largest (draw, key) among the first k of each stratum, NULL if there is none."""
    strata = list(strata)
    cell = F.floor(F.col(draw) * RANK_CELLS)
    slim = df.select(*strata, F.col(draw).alias("_u"), F.col(key).alias("_k"), cell.alias("_cell"))

    counts = slim.groupBy(*strata, "_cell").agg(F.count(F.lit(1)).alias("_rows"))
    by_cell = Window.partitionBy(*strata).orderBy("_cell")
    running = counts.select(
        *strata, "_cell",
        F.sum("_rows").over(by_cell).alias("_upto"),
        (F.sum("_rows").over(by_cell) - F.col("_rows")).alias("_before"),
        F.sum("_rows").over(Window.partitionBy(*strata)).alias("_n"),
    )
    targets = F.array(*[
        F.struct(F.lit(name).alias("name"), k(F.col("_n")).cast("bigint").alias("k"))
        for name, k in quotas.items()
    ])
    edges = (
        running.withColumn("_t", F.explode(targets))
        .where("_t.k > _before AND _t.k <= _upto")
        .select(*strata, "_cell", F.col("_t.name").alias("_name"),
                (F.col("_t.k") - F.col("_before")).alias("_rank"))
    )
    edges = small_table(edges)

    in_cell = Window.partitionBy(*strata, "_cell", "_name").orderBy("_u", "_k")
    hits = (
        join_null_safe(slim, edges, [*strata, "_cell"])
        .withColumn("_rn", F.row_number().over(in_cell))
        .where("_rn = _rank")
    )
    cuts = hits.groupBy(*strata).agg(*[
        F.max(F.when(F.col("_name") == name, F.struct("_u", "_k"))).alias(f"_cut_{name}")
        for name in quotas
    ])
    return small_table(cuts)


# ---------------------------------------------------------------------------
# running totals, and the area under the ROC curve
# ---------------------------------------------------------------------------

def running_before(df: DataFrame, keys: Sequence[str], order: str, totals: Sequence[str]) -> DataFrame:
    """Add ``<c>_before`` for each of ``totals``: its sum over the rows of the same keys with a smaller ``order``.

    The rows are range-partitioned, so a partition holds one short range however close the values lie. Sums of
    whole partitions give the offsets; windows run inside a partition only. (keys, order) must be unique.
    """
    keys = list(keys)
    placed = cut_lineage(df.repartitionByRange(*keys, order).withColumn("_block", F.spark_partition_id()))
    earlier = Window.unboundedPreceding, -1
    blocks = placed.groupBy(*keys, "_block").agg(*[F.sum(c).alias(f"_{c}") for c in totals])
    by_block = Window.partitionBy(*keys).orderBy("_block").rowsBetween(*earlier)
    offsets = blocks.select(*keys, "_block", *[F.coalesce(F.sum(f"_{c}").over(by_block), F.lit(0)).alias(f"_{c}") for c in totals])
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(*earlier)
    out = join_null_safe(placed, offsets, [*keys, "_block"])
    for c in totals:
        out = out.withColumn(f"{c}_before", F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_{c}"))
    return out.drop("_block", *[f"_{c}" for c in totals])


def roc_auc(df: DataFrame, keys: Sequence[str], score: str, positive: Column,
            name: str = "roc_auc") -> DataFrame:
    """Tie-aware ROC-AUC per ``keys``; NULL where only one class is present."""
    packed = curves.pack_scores(df.where(F.col(score).isNotNull()), keys, F.when(positive, 1).otherwise(0), F.array(score), first_class=1)
    return curves.area(cut_lineage(packed), keys, name)


def roc_auc_ovr(df: DataFrame, keys: Sequence[str], probs: str, y_true: str,
                name: str = "roc_auc") -> DataFrame:
    """One-vs-rest macro mean; NULL if any class has no positive or no negative row."""
    keys = list(keys)
    packed = curves.pack_scores(df, keys, F.coalesce(F.col(y_true), F.lit(-1)), F.col(probs))
    return mean_over_classes(curves.area(cut_lineage(packed), [*keys, "_class"], "_auc"), keys, name)


def mean_over_classes(per_class: DataFrame, keys: Sequence[str], name: str = "roc_auc") -> DataFrame:
    """Mean of ``_auc`` per keys; NULL if one class has none."""
    return per_class.groupBy(*keys).agg(
        F.when(F.count("_auc") == F.count(F.lit(1)), F.avg("_auc")).alias(name))


# ---------------------------------------------------------------------------
# exact quantiles
# ---------------------------------------------------------------------------

def _value_cell(value: Column) -> Column:
    """Non-decreasing integer key below 65536; cells are about 3 % wide relative to the value."""
    t = F.signum(value) * F.log1p(F.abs(value) * F.lit(1e6))
    return F.floor((t + F.lit(1024.0)) * F.lit(32.0))


def exact_quantiles(long: DataFrame, probs: Sequence[float]) -> DataFrame:
    """Quantiles with linear interpolation of ``long(feature, value)``.

    Returns (feature, prob, n, quantile). NULL and NaN are left out. Passes over the table narrow each wanted rank
    down: first logarithmic cells, then 65536 equal parts of the range of the cell that holds the rank, until that
    cell is one value. A pass counts per cell before its shuffle, so no window sees more than 65536 rows, however
    close the values lie; two to four passes are usual. Between passes only the wanted ranks (features by probabilities) come to the driver.
    """
    spark = long.sparkSession
    rows = long.where(F.col("value").isNotNull() & ~F.isnan("value")).select("feature", F.col("value").cast("double").alias("value"))
    ends = F.count(F.lit(1)).alias("_rows"), F.min("value").alias("lo"), F.max("value").alias("hi")
    first = Window.partitionBy("feature").orderBy("cell")
    counted = rows.groupBy("feature", _value_cell(F.col("value")).alias("cell")).agg(*ends)
    cells = counted.withColumn("_before", F.sum("_rows").over(first) - F.col("_rows")).withColumn(
        "n", F.sum("_rows").over(Window.partitionBy("feature")))
    spot = F.array(*[F.struct(F.lit(float(p)).alias("prob"), (F.lit(float(p)) * (F.col("n") - 1)).alias("h")) for p in probs])
    wanted = cells.withColumn("_p", F.explode(spot)).withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    wanted = wanted.withColumn("rank", F.when(F.col("side") == 0, F.floor("_p.h")).otherwise(F.ceil("_p.h")))
    columns = "feature", "prob", "h", "n", "side", "rank", "lo", "hi"
    hit = F.expr("rank >= _before AND rank < _before + _rows")
    found = wanted.select("*", "_p.prob", "_p.h").where(hit).withColumn("rank", F.col("rank") - F.col("_before")).select(*columns)
    schema, spots = found.schema, found.toArrow()
    while pc.any(pc.less(spots["lo"], spots["hi"])).as_py():
        done = spots.filter(pc.equal(spots["lo"], spots["hi"]))
        searched = spark.createDataFrame(spots.filter(pc.less(spots["lo"], spots["hi"])), schema)
        ranges = searched.select("feature", "lo", "hi").distinct().withColumnsRenamed({"lo": "_lo", "hi": "_hi"})
        near = rows.join(ranges, "feature").where("value >= _lo AND value <= _hi")
        # Halves first, so that the width of no range overflows.
        part = (F.col("value") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        inner = near.groupBy("feature", "_lo", "_hi", F.floor(part * 65535).alias("cell")).agg(*ends)
        over = Window.partitionBy("feature", "_lo", "_hi").orderBy("cell")
        inner = inner.withColumn("_before", F.sum("_rows").over(over) - F.col("_rows"))
        asked = searched.select("feature", "prob", "h", "n", "side", "rank", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
        found = inner.join(asked, ["feature", "_lo", "_hi"]).where(hit).withColumn("rank", F.col("rank") - F.col("_before")).select(*columns)
        spots = pa.concat_tables([done, found.toArrow().cast(done.schema)])
    value = F.max(F.when(F.col("side") == 0, F.col("lo"))), F.max(F.when(F.col("side") == 1, F.col("lo")))
    return spark.createDataFrame(spots, schema).groupBy("feature", "prob").agg(
        F.max("n").alias("n"), (value[0] + (value[1] - value[0]) * (F.max("h") - F.floor(F.max("h")))).alias("quantile"))


def to_long(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One (feature, value) row per numeric feature and row."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"))
                      for f in features])
    return df.select(F.inline(pairs))


def vector_to_long(df: DataFrame, features: str) -> DataFrame:
    return df.select(F.posexplode(features).alias("feature", "value"))
