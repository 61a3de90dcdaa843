"""Sampling, splitting, scaling, bounds and oversampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinel.functions.cols import l2_norm, rnd
from sentinel.operators import sample, scale, smote
from sentinel.operators.ranking import exact_quantiles, to_long
from sentinel.sources import tables
from workload import inputs as I
from workload.registry import ctes, query

SUBSET = 4000
LINE_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(f"""SELECT o_orderkey, o_orderstatus FROM (SELECT o_orderkey, o_orderstatus,
  row_number() OVER (PARTITION BY o_orderstatus ORDER BY {I.sql_uniform('subset', 'o_orderkey')}, o_orderkey) AS rn,
  count(*) OVER (PARTITION BY o_orderstatus) AS n, count(*) OVER () AS total FROM orders)
WHERE rn <= floor(CAST(n AS DOUBLE) / CAST(total AS DOUBLE) * {SUBSET}e0)""")
def stratified_subset(spark: SparkSession, sf: str) -> DataFrame:
    o = I.read(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return sample.stratified_subset(o, SUBSET, "o_orderkey", I.SEED, "o_orderstatus")


@query(f"SELECT o_orderkey, o_orderstatus, {I.sql_uniform('shuffle', 'o_orderkey')} AS draw FROM orders")
def shuffle_rows(spark: SparkSession, sf: str) -> DataFrame:
    o = I.read(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return sample.shuffle_rows(o, "o_orderkey", I.SEED).withColumn(
        "draw", I.uniform(I.SEED, "shuffle", "o_orderkey"))


_SPLIT = f"""ranked AS (SELECT row_id, label_multiclass, count(*) OVER (PARTITION BY label_multiclass) AS n,
  row_number() OVER (PARTITION BY label_multiclass ORDER BY {I.sql_uniform('split', 'row_id')}, row_id) AS rn
  FROM flows),
cut AS (SELECT *, floor(n * 0.2e0 + 0.5e0) AS nt FROM ranked),
split3 AS (SELECT row_id, label_multiclass, CASE WHEN rn <= nt THEN 'test'
  WHEN rn <= nt + floor((n - nt) * 0.25e0 + 0.5e0) THEN 'val' ELSE 'train' END AS split FROM cut)"""


@query(ctes(I.SQL_FLOWS, _SPLIT) + "SELECT row_id, label_multiclass, split FROM split3")
def three_way_split(spark: SparkSession, sf: str) -> DataFrame:
    return sample.add_split(I.flows(spark, sf).select("row_id", "label_multiclass"), "row_id", seed=I.SEED)


@query(ctes(I.SQL_FLOWS, _SPLIT) + "SELECT split, count(*) AS n_rows FROM split3 GROUP BY 1")
def split_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tables.split_counts(three_way_split(spark, sf))


@query(f"""SELECT l_returnflag, n_rows, {I.sql_round('total / (k * CAST(n_rows AS DOUBLE))')} AS weight
FROM (SELECT l_returnflag, count(*) AS n_rows, sum(count(*)) OVER () AS total, count(*) OVER () AS k
      FROM lineitem GROUP BY 1)""")
def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    return sample.class_weights(I.read(spark, sf, "lineitem"), "l_returnflag").withColumn(
        "weight", rnd("weight", 6))


@query(ctes(I.SQL_FLOWS, f"""weighted AS (SELECT row_id, label_multiclass, count(*) OVER () / (
  (SELECT count(DISTINCT label_multiclass) FROM flows) * CAST(count(*) OVER (PARTITION BY label_multiclass) AS DOUBLE)) AS w FROM flows)""") +
       f"""SELECT label_multiclass, row_id, CAST(floor(w + {I.sql_uniform('resample', 'row_id')}) AS BIGINT) AS copies
FROM weighted WHERE floor(w + {I.sql_uniform('resample', 'row_id')}) > 0""")
def weighted_resample(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.flows(spark, sf).select("row_id", "label_multiclass")
    drawn = sample.resample_balanced(rows, "label_multiclass", "row_id", I.SEED)
    return drawn.groupBy("label_multiclass", "row_id").agg(F.count(F.lit(1)).alias("copies"))


_TRAIN = f"""placed AS (SELECT *, {I.SQL_SPLIT.format(u=I.sql_uniform('part', "'events'", 'row_id'))} AS split
  FROM flows)"""


def _placed(spark: SparkSession, sf: str) -> DataFrame:
    return I.flows(spark, sf).withColumn("split", I.split_of("events", "row_id"))


_SCALED = ", ".join(
    f"{I.sql_round(f'({c} - (SELECT avg({c}) FROM t)) / (SELECT coalesce(nullif(stddev_pop({c}), 0), 1) FROM t)')}"
    f" AS {c}" for c in I.FLOW_FEATURES)


@query(ctes(I.SQL_FLOWS, _TRAIN, "t AS (SELECT * FROM placed WHERE split = 'train')") +
       f"SELECT row_id, split, {_SCALED} FROM placed")
def standardize(spark: SparkSession, sf: str) -> DataFrame:
    rows = _placed(spark, sf).select("row_id", "split", *I.FLOW_FEATURES)
    scaler = scale.fit_scaler(rows.where("split = 'train'"), I.FLOW_FEATURES)
    return scale.apply_scaler(rows, scaler, I.FLOW_FEATURES).select(
        "row_id", "split", *[rnd(c, 6).alias(c) for c in I.FLOW_FEATURES])


_NORM = "sqrt(list_sum([CAST(v AS DOUBLE) * CAST(v AS DOUBLE) for v in embedding]))"


@query(f"""SELECT n, {I.sql_round('median_norm')} AS median_norm, {I.sql_round('norm_p99')} AS norm_p99,
{I.sql_round('norm_p99 * 1.05e0')} AS bound FROM (SELECT count(*) AS n, quantile_cont(norm, 0.5) AS median_norm,
quantile_cont(norm, 0.99) AS norm_p99 FROM (SELECT {_NORM} AS norm FROM embeddings))""")
def row_norm_bound(spark: SparkSession, sf: str) -> DataFrame:
    return scale.norm_bound(I.read(spark, sf, "embeddings"), "embedding").select(
        "n", *[rnd(c, 6).alias(c) for c in ("median_norm", "norm_p99", "bound")])


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, {I.sql_round('lo - (hi - lo) * 0.1e0')} AS lower_bound, "
    f"{I.sql_round('hi + (hi - lo) * 0.1e0')} AS upper_bound FROM (SELECT quantile_cont({c}, 0.01) AS lo, "
    f"quantile_cont({c}, 0.99) AS hi FROM lineitem)" for c in LINE_FEATURES))
def feature_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return scale.feature_bounds(I.read(spark, sf, "lineitem"), LINE_FEATURES).select(
        "feature", rnd("lower", 6).alias("lower_bound"), rnd("upper", 6).alias("upper_bound"))


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, {p}e0 AS prob, count({c}) AS n, "
    f"{I.sql_round(f'quantile_cont({c}, {p})')} AS quantile FROM lineitem"
    for c in LINE_FEATURES for p in (0.0, 0.25, 0.5, 0.9, 1.0)))
def exact_quantile(spark: SparkSession, sf: str) -> DataFrame:
    long = to_long(I.read(spark, sf, "lineitem"), LINE_FEATURES)
    return exact_quantiles(long, [0.0, 0.25, 0.5, 0.9, 1.0]).withColumn("quantile", rnd("quantile", 6))


@query(f"""SELECT vec_id, {I.sql_round('least(norm, 0.8e0)')} AS clipped_norm,
{I.sql_round('s * CASE WHEN norm > 0.8e0 THEN 0.8e0 / norm ELSE 1e0 END', 5)} AS clipped_sum
FROM (SELECT vec_id, {_NORM} AS norm, list_sum([CAST(v AS DOUBLE) for v in embedding]) AS s
FROM embeddings)""")
def clip_rows(spark: SparkSession, sf: str) -> DataFrame:
    e = I.read(spark, sf, "embeddings").withColumn("x", scale.clip_to_norm(F.col("embedding"), 0.8))
    return e.select("vec_id", rnd(l2_norm("x"), 6).alias("clipped_norm"),
                    rnd(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 5).alias("clipped_sum"))


@query("""SELECT l_returnflag, round(sum(greatest(5e0, least(45e0, l_quantity))), 2) AS qty,
round(sum(greatest(1000e0, least(50000e0, l_extendedprice))), 2) AS price FROM lineitem GROUP BY 1""")
def clip_bounds(spark: SparkSession, sf: str) -> DataFrame:
    x = scale.assemble(I.read(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"])
    x = x.withColumn("x", scale.clip_to_bounds(F.col("features"), [5, 1000], [45, 50000]))
    return x.groupBy("l_returnflag").agg(
        F.round(F.sum(F.get("x", F.lit(0))), 2).alias("qty"), F.round(F.sum(F.get("x", F.lit(1))), 2).alias("price"))


_NEAR = """near AS (SELECT vec_id, label, CAST(rn AS INTEGER) AS rank, neighbor, d FROM (
SELECT a.vec_id, a.label, b.vec_id AS neighbor, d, row_number() OVER (PARTITION BY a.vec_id ORDER BY d, b.vec_id) AS rn
FROM (SELECT x.vec_id AS i, y.vec_id AS j,
  list_distance(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) AS d
  FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id <> y.vec_id) p
JOIN embeddings a ON a.vec_id = p.i JOIN embeddings b ON b.vec_id = p.j) WHERE rn <= 5)"""


@query(ctes(_NEAR) + "SELECT vec_id, label, rank, neighbor, round(d, 5) AS distance FROM near")
def smote_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    e = I.read(spark, sf, "embeddings")
    return smote.nearest_neighbors(e, "vec_id", "embedding", "label").withColumn(
        "distance", F.round("distance", 5))


@query(ctes(_NEAR, f"""sizes AS (SELECT label, count(*) AS n, max(count(*)) OVER () - count(*) AS m FROM embeddings GROUP BY 1),
planned AS (SELECT vec_id, label, embedding, m // n + CASE WHEN rn <= m % n THEN 1 ELSE 0 END AS copies FROM (
  SELECT e.*, n, m, row_number() OVER (PARTITION BY e.label ORDER BY {I.sql_uniform('smote', 'e.vec_id')}, e.vec_id) AS rn
  FROM embeddings e JOIN sizes s ON e.label = s.label WHERE m > 0)),
one AS (SELECT vec_id, label, embedding, unnest(range(1, copies + 1)) AS copy FROM planned),
k AS (SELECT vec_id, max(rank) AS k FROM near GROUP BY 1),
picked AS (SELECT o.*, floor({I.sql_uniform('pick', 'o.vec_id', 'copy')} * k) + 1 AS rank, {I.sql_uniform('step', 'o.vec_id', 'copy')} AS s
  FROM one o JOIN k ON o.vec_id = k.vec_id)""") + f"""SELECT p.label, p.vec_id AS origin, n.neighbor, p.copy, {I.sql_round(
    "sqrt(list_sum([power(CAST(p.embedding[i] AS DOUBLE) + s * (CAST(b.embedding[i] AS DOUBLE) - CAST(p.embedding[i] AS DOUBLE)), 2) for i in range(1, len(p.embedding) + 1)]))")} AS norm
FROM picked p JOIN near n ON n.vec_id = p.vec_id AND n.rank = p.rank JOIN embeddings b ON b.vec_id = n.neighbor""")
def smote_rows(spark: SparkSession, sf: str) -> DataFrame:
    e = I.read(spark, sf, "embeddings")
    return smote.smote(e, "vec_id", "embedding", "label", seed=I.SEED).select(
        "label", "origin", "neighbor", "copy", rnd(l2_norm("embedding"), 6).alias("norm"))
