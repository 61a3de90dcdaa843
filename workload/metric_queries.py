"""Evaluation metrics over the predictions of all runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinel.functions.cols import argmax, rnd, softmax
from sentinel.operators import metrics as M
from sentinel.operators.ranking import roc_auc, roc_auc_ovr
from workload import inputs as I
from workload.registry import ctes, query

KEYS = ["run_id", "split"]
HELD_OUT = "held AS (SELECT * FROM preds WHERE split <> 'train')"
BASE = ctes(I.sql_rows(), I.sql_runs(), I.SQL_PREDS, HELD_OUT)

SQL_CONF = "conf AS (SELECT run_id, split, y_true, y_pred, count(*) AS n FROM held GROUP BY ALL)"
SQL_CLASS = """pc0 AS (SELECT run_id, split, cls, sum(tp) AS tp, sum(sup) AS sup, sum(pred) AS pred FROM (
  SELECT run_id, split, y_true AS cls, n AS sup, 0 AS pred, CASE WHEN y_true = y_pred THEN n ELSE 0 END AS tp FROM conf
  UNION ALL SELECT run_id, split, y_pred, 0, n, 0 FROM conf) GROUP BY ALL),
pc AS (SELECT run_id, split, cls, CAST(tp AS DOUBLE) AS tp, CAST(sup AS DOUBLE) AS sup, CAST(pred AS DOUBLE) AS pred,
  CASE WHEN pred = 0 THEN 0e0 ELSE tp / CAST(pred AS DOUBLE) END AS prec,
  CASE WHEN sup = 0 THEN 0e0 ELSE tp / CAST(sup AS DOUBLE) END AS rec,
  CASE WHEN sup + pred = 0 THEN 0e0 ELSE 2 * tp / CAST(sup + pred AS DOUBLE) END AS f1 FROM pc0)"""
SQL_SCALARS = """sc AS (SELECT run_id, split, sum(tp) / sum(sup) AS accuracy, avg(f1) AS f1_macro,
  sum(f1 * sup) / sum(sup) AS f1_weighted, avg(prec) AS precision_macro, avg(rec) AS recall_macro,
  CASE WHEN max(sup) = sum(sup) OR max(pred) = sum(sup) THEN 0e0 ELSE
    (sum(tp) * sum(sup) - sum(pred * sup)) / sqrt((sum(sup) * sum(sup) - sum(pred * pred))
    * (sum(sup) * sum(sup) - sum(sup * sup))) END AS mcc FROM pc GROUP BY ALL)"""
SQL_RATES = """rates AS (SELECT run_id, split,
  CASE WHEN k = 2 THEN CASE WHEN fp + tn = 0 THEN 0e0 ELSE fp / CAST(fp + tn AS DOUBLE) END END AS false_positive_rate,
  CASE WHEN k = 2 THEN CASE WHEN tp + fn = 0 THEN 0e0 ELSE tp / CAST(tp + fn AS DOUBLE) END END AS detection_rate,
  CASE WHEN k = 2 THEN CASE WHEN tp + fn = 0 THEN 0e0 ELSE fn / CAST(tp + fn AS DOUBLE) END END AS false_negative_rate,
  tn, fp, fn, tp FROM (SELECT run_id, split,
    coalesce(sum(n) FILTER (y_true = 0 AND y_pred = 0), 0) AS tn, coalesce(sum(n) FILTER (y_true = 0 AND y_pred = 1), 0) AS fp,
    coalesce(sum(n) FILTER (y_true = 1 AND y_pred = 0), 0) AS fn, coalesce(sum(n) FILTER (y_true = 1 AND y_pred = 1), 0) AS tp
    FROM conf GROUP BY ALL) JOIN (SELECT run_id, split, count(*) AS k FROM pc GROUP BY ALL) USING (run_id, split))"""


def sql_auc(source: str, keys: str, score: str = "score", pos: str = "y_true") -> str:
    return f"""SELECT {keys}, sum(p * (below + 0.5e0 * n)) / nullif(sum(p) * sum(n), 0) AS roc_auc FROM (
  SELECT {keys}, p, n, coalesce(sum(n) OVER (PARTITION BY {keys} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING
    AND 1 PRECEDING), 0e0) AS below FROM (SELECT {keys}, {score} AS s, CAST(sum({pos}) AS DOUBLE) AS p,
    CAST(sum(1 - {pos}) AS DOUBLE) AS n FROM {source} GROUP BY ALL)) GROUP BY {keys}"""


SQL_AUC = f"auc AS ({sql_auc('held', 'run_id, split')})"
SQL_SUITE = ",\n".join([SQL_CONF, SQL_CLASS, SQL_SCALARS, SQL_RATES, SQL_AUC])
SCALARS = ("accuracy", "f1_macro", "f1_weighted", "precision_macro", "recall_macro", "mcc")
RATES = ("false_positive_rate", "detection_rate", "false_negative_rate")


_LOGITS = ("l_quantity / 10", "l_extendedprice / 20000", "l_discount * 20")


@query(f"""SELECT l_suppkey, pick, count(*) AS n_rows, {I.sql_round('avg(e0 / (e0 + e1 + e2))')} AS mean_p0,
{I.sql_round('avg(greatest(e0, e1, e2) / (e0 + e1 + e2))')} AS mean_confidence FROM (
SELECT l_suppkey, exp(z0) AS e0, exp(z1) AS e1, exp(z2) AS e2,
  CASE WHEN z0 >= z1 AND z0 >= z2 THEN 0 WHEN z1 >= z2 THEN 1 ELSE 2 END AS pick
  FROM (SELECT l_suppkey, {', '.join(f'{z} AS z{i}' for i, z in enumerate(_LOGITS))} FROM lineitem)) GROUP BY ALL""")
def class_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    """Softmax and argmax of per-row class scores."""
    logits = F.array(*[F.expr(z) for z in _LOGITS])
    probs = I.read(spark, sf, "lineitem").select("l_suppkey", logits.alias("z")).withColumn(
        "pick", argmax(F.col("z"))).withColumn("p", softmax(F.col("z")))
    return rounded(probs.groupBy("l_suppkey", "pick").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(F.get("p", F.lit(0))).alias("mean_p0"),
        F.avg(F.array_max("p")).alias("mean_confidence")), ["l_suppkey", "pick", "n_rows"],
        ["mean_p0", "mean_confidence"])


def _conf(spark: SparkSession, sf: str) -> DataFrame:
    return M.confusion(I.predictions(spark, sf), KEYS)


def _r(names) -> str:
    return ", ".join(f"{I.sql_round(n)} AS {n}" for n in names)


def rounded(df: DataFrame, keep, names) -> DataFrame:
    return df.select(*keep, *[rnd(n, 6).alias(n) for n in names])


@query(BASE + ", " + SQL_CONF + " SELECT * FROM conf")
def confusion_long(spark: SparkSession, sf: str) -> DataFrame:
    return _conf(spark, sf)


@query(BASE + ", " + SQL_CONF + f"""SELECT g.run_id, g.split, g.y_true, g.y_pred, coalesce(n, 0) AS n,
  {I.sql_round('coalesce(n, 0) / CAST(sum(coalesce(n, 0)) OVER (PARTITION BY g.run_id, g.split, g.y_true) AS DOUBLE)')} AS row_share,
  {I.sql_round('coalesce(n, 0) / CAST(sum(coalesce(n, 0)) OVER (PARTITION BY g.run_id, g.split) AS DOUBLE)')} AS total_share
  FROM (SELECT DISTINCT a.run_id, a.split, t.v AS y_true, p.v AS y_pred FROM conf a
        CROSS JOIN (VALUES (0), (1)) t(v) CROSS JOIN (VALUES (0), (1)) p(v)) g LEFT JOIN conf c
  ON c.run_id = g.run_id AND c.split = g.split AND c.y_true = g.y_true AND c.y_pred = g.y_pred""")
def confusion_normalized(spark: SparkSession, sf: str) -> DataFrame:
    dense = M.confusion_dense(_conf(spark, sf), KEYS)
    return rounded(dense, [*KEYS, "y_true", "y_pred", "n"], ["row_share", "total_share"])


@query(BASE + ", " + SQL_CONF + ", " + SQL_CLASS + ", " + SQL_RATES + """
SELECT run_id, split, concat(tn, ',', fp, ';', fn, ',', tp) AS matrix FROM rates""")
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    m = M.confusion_matrix(_conf(spark, sf), KEYS)
    row = lambda r: F.concat_ws(",", F.transform(r, lambda v: v.cast("string")))
    return m.select(*KEYS, F.concat_ws(";", F.transform("confusion_matrix", row)).alias("matrix"))


@query(BASE + ", " + SQL_CONF + ", " + SQL_CLASS + ", " + SQL_RATES + f"""
SELECT run_id, split, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
CAST(tp AS BIGINT) AS tp, {', '.join(I.sql_round(f'{c} / CAST(tn + fp + fn + tp AS DOUBLE)') + f' AS {c}_share'
                                     for c in ('tn', 'fp', 'fn', 'tp'))} FROM rates""")
def binary_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.binary_counts(_conf(spark, sf), KEYS), [*KEYS, "tn", "fp", "fn", "tp"],
                   ["tn_share", "fp_share", "fn_share", "tp_share"])


@query(BASE + f"""SELECT run_id, split, {I.sql_round('avg(CASE WHEN y_true = y_pred THEN 1e0 ELSE 0e0 END)')}
AS accuracy FROM held GROUP BY ALL""")
def accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.scalar_metrics(_conf(spark, sf), KEYS), KEYS, ["accuracy"])


@query(BASE + ", " + SQL_CONF + ", " + SQL_CLASS + f"""SELECT run_id, split, cls AS class, CAST(tp AS BIGINT) AS tp,
CAST(sup AS BIGINT) AS support, CAST(pred AS BIGINT) AS predicted, {I.sql_round('prec')} AS "precision",
{I.sql_round('rec')} AS recall, {I.sql_round('f1')} AS f1 FROM pc""")
def per_class_prf(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.per_class(_conf(spark, sf), KEYS), [*KEYS, "class", "tp", "support", "predicted"],
                   ["precision", "recall", "f1"])


@query(BASE + ", " + SQL_CONF + ", " + SQL_CLASS + ", " + SQL_SCALARS + f"""
SELECT run_id, split, {_r(SCALARS[1:5])} FROM sc""")
def macro_weighted_f1(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.scalar_metrics(_conf(spark, sf), KEYS), KEYS, SCALARS[1:5])


@query(BASE + ", " + SQL_CONF + ", " + SQL_CLASS + ", " + SQL_SCALARS + f"SELECT run_id, split, {_r(['mcc'])} FROM sc")
def mcc(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.scalar_metrics(_conf(spark, sf), KEYS), KEYS, ["mcc"])


@query(BASE + ", " + SQL_CONF + ", " + SQL_CLASS + ", " + SQL_RATES + f"SELECT run_id, split, {_r(RATES)} FROM rates")
def fpr_dr_fnr(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.scalar_metrics(_conf(spark, sf), KEYS, binary=True), KEYS, RATES)


@query(BASE + ", " + SQL_AUC + f" SELECT run_id, split, {_r(['roc_auc'])} FROM auc")
def roc_auc_binary(spark: SparkSession, sf: str) -> DataFrame:
    p = I.predictions(spark, sf).select(*KEYS, "y_true", F.get("probs", F.lit(1)).alias("score"))
    return rounded(roc_auc(p, KEYS, "score", F.col("y_true") == 1), KEYS, ["roc_auc"])


@query("WITH p AS (SELECT l_suppkey, l_discount * 10 AS s, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS hit "
       f"FROM lineitem) SELECT l_suppkey, {I.sql_round('roc_auc')} AS roc_auc FROM "
       f"({sql_auc('p', 'l_suppkey', 's', 'hit')})")
def roc_auc_ties(spark: SparkSession, sf: str) -> DataFrame:
    li = I.read(spark, sf, "lineitem").withColumn("s", F.col("l_discount") * 10)
    return rounded(roc_auc(li, ["l_suppkey"], "s", F.col("l_returnflag") == "R"), ["l_suppkey"], ["roc_auc"])


MULTI = ctes(I.sql_rows(), I.sql_runs(), I.SQL_MULTI,
             "held AS (SELECT * FROM multi WHERE split <> 'train')")
_LONG = " UNION ALL ".join(
    f"SELECT run_id, split, {c} AS class, p{c} AS score, CASE WHEN y_true = {c} THEN 1 ELSE 0 END AS hit FROM held"
    for c in range(5))
SQL_OVR = f"""long AS ({_LONG}), aucs AS ({sql_auc('long', 'run_id, split, class', 'score', 'hit')}),
auc AS (SELECT run_id, split, CASE WHEN count(roc_auc) = count(*) THEN avg(roc_auc) END AS roc_auc
  FROM aucs GROUP BY ALL)"""


@query(MULTI + ", " + SQL_OVR + f" SELECT run_id, split, {_r(['roc_auc'])} FROM auc")
def roc_auc_one_vs_rest(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(roc_auc_ovr(I.multi_predictions(spark, sf), KEYS, "probs", "y_true"), KEYS, ["roc_auc"])


@query(BASE + ", " + SQL_SUITE + f""" SELECT run_id, split, {_r([*SCALARS, *RATES, 'roc_auc'])}
FROM sc JOIN rates USING (run_id, split) JOIN auc USING (run_id, split)""")
def metric_suite(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.evaluate(I.predictions(spark, sf), KEYS), KEYS, [*SCALARS, *RATES, "roc_auc"])


@query(MULTI + ", " + ", ".join([SQL_CONF, SQL_CLASS, SQL_SCALARS, SQL_OVR]) + f"""
SELECT run_id, split, {_r([*SCALARS, 'roc_auc'])} FROM sc JOIN auc USING (run_id, split)""")
def metric_suite_multiclass(spark: SparkSession, sf: str) -> DataFrame:
    suite = M.evaluate(I.multi_predictions(spark, sf), KEYS, "multiclass")
    return rounded(suite, KEYS, [*SCALARS, "roc_auc"])


@query(MULTI + ", " + ", ".join([SQL_CONF, SQL_CLASS]) + """
SELECT run_id, split, string_agg(cls || '=' || CAST(CAST(round(f1 * 1000000) AS BIGINT) AS VARCHAR), ',' ORDER BY cls)
AS per_class_f1 FROM pc GROUP BY ALL""")
def per_class_f1(spark: SparkSession, sf: str) -> DataFrame:
    m = M.per_class_f1_map(M.confusion(I.multi_predictions(spark, sf), KEYS), KEYS)
    text = F.transform(F.array_sort(F.map_entries("per_class_f1")), lambda e: F.concat_ws(
        "=", e["key"], F.round(e["value"] * 1000000).cast("bigint").cast("string")))
    return m.select(*KEYS, F.concat_ws(",", text).alias("per_class_f1"))


_AVG = lambda kind, expr: (
    f"SELECT run_id, split, '{kind} avg' AS row, " +
    ", ".join(f"{expr.format(m=m)} AS {n}" for m, n in (("prec", '"precision"'), ("rec", "recall"), ("f1", "f1"))) +
    ", sum(sup) AS support FROM pc GROUP BY run_id, split")
_REPORT = f"""SELECT run_id, split, CAST(cls AS VARCHAR) AS row, prec AS "precision", rec AS recall, f1, sup AS support FROM pc
UNION ALL SELECT run_id, split, 'accuracy', NULL, NULL, sum(tp) / sum(sup), sum(sup) FROM pc GROUP BY run_id, split
UNION ALL {_AVG('macro', 'avg({m})')} UNION ALL {_AVG('weighted', 'sum({m} * sup) / sum(sup)')}"""


@query(MULTI + ", " + ", ".join([SQL_CONF, SQL_CLASS]) + f"""
SELECT run_id, split, row, {I.sql_round('"precision"')} AS "precision", {I.sql_round('recall')} AS recall,
{I.sql_round('f1')} AS f1, CAST(support AS BIGINT) AS support FROM ({_REPORT})""")
def classification_report(spark: SparkSession, sf: str) -> DataFrame:
    rep = M.classification_report(M.confusion(I.multi_predictions(spark, sf), KEYS), KEYS)
    return rounded(rep, [*KEYS, "row", "support"], ["precision", "recall", "f1"])
