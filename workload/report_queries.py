"""Result store, comparison, tradeoff and findings tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentinel.functions.cols import rnd
from sentinel.functions.storage import shared_dir
from sentinel.plans import evaluate, reports
from sentinel.schema import COMPARISON_METRICS, DISPLAY_NAMES, EPSILON_GRID, RESULT_SCHEMA
from sentinel.sources import ledger
from workload import inputs as I
from workload.metric_queries import SQL_AUC, SQL_CLASS, SQL_CONF, SQL_RATES, SQL_SCALARS
from workload.registry import ctes, query

SQL_RESULTS = f"""results AS (SELECT m.dataset, m.label_type, m.model_name, m.epsilon, m.delta, m.actual_epsilon,
  m.train_time_s, {{auc}} AS roc_auc, s.*, r.false_positive_rate, r.detection_rate, r.false_negative_rate
  FROM sc s JOIN rates r USING (run_id, split) {{join}} JOIN run_meta m USING (run_id))"""


def base(orders: bool = False, auc: bool = True, split: str = "split = 'test'") -> str:
    parts = [I.sql_rows(orders), I.sql_runs(), I.SQL_PREDS, I.SQL_RUN_META,
             f"held AS (SELECT * FROM preds WHERE {split})", SQL_CONF, SQL_CLASS, SQL_SCALARS, SQL_RATES]
    if auc:
        return ctes(*parts, SQL_AUC, SQL_RESULTS.format(auc="a.roc_auc", join="JOIN auc a USING (run_id, split)"))
    return ctes(*parts, SQL_RESULTS.format(auc="CAST(NULL AS DOUBLE)", join=""))


def results(spark: SparkSession, sf: str, orders: bool = False, auc: bool = True,
            splits=("test",)) -> DataFrame:
    return evaluate.result_rows(I.predictions(spark, sf, splits, orders), I.run_table(spark, sf, orders), auc=auc)


FULL, PLAIN = base(), base(auc=False)
SQL_NAME = I.sql_case(DISPLAY_NAMES, "model_name", "model_name")
SQL_TITLE = I.sql_case({m: m.replace("_", " ").title() for m in I.BASELINE_MODELS}, "model_name", "model_name")
SQL_FAMILY = f"CASE WHEN epsilon IS NULL THEN 'Baseline' ELSE {SQL_NAME} END"
# 0.01 -> '0.01', 1.0 -> '1.0': the text form of the budget grid
SQL_EPS_TEXT = "CASE " + " ".join(f"WHEN epsilon = {e!r}e0 THEN '{e!r}'" for e in EPSILON_GRID) + " END"
SQL_LABEL = f"CASE WHEN epsilon IS NULL THEN {SQL_TITLE} ELSE {SQL_NAME} || ' ε=' || {SQL_EPS_TEXT} END"
BEST = """best AS (SELECT * FROM (SELECT dataset, label_type, model_name AS base_model, f1_macro AS base,
  row_number() OVER (PARTITION BY dataset, label_type ORDER BY f1_macro DESC, model_name) AS rn
  FROM results WHERE epsilon IS NULL) WHERE rn = 1)"""
LR = "lr AS (SELECT dataset, label_type, f1_macro AS base FROM results WHERE model_name = 'logistic_regression')"
r4 = lambda e: I.sql_round(e, 4)


# -- comparison and tradeoff ---------------------------------------------------

@query(base(orders=True) + f"""SELECT {SQL_NAME} AS model, dataset, label_type, epsilon,
{', '.join(f'{r4(m)} AS {m}' for m in COMPARISON_METRICS)}, {I.sql_round('train_time_s', 1)} AS train_time_s
FROM results""")
def comparison_table(spark: SparkSession, sf: str) -> DataFrame:
    return reports.comparison_table(results(spark, sf, orders=True))


_LOSS = "CASE WHEN base > 0 THEN " + I.sql_round("base - f1_macro", 4) + " END"
_PCT = "CASE WHEN base > 0 THEN " + I.sql_round("100e0 * (base - f1_macro) / base", 2) + " END"
_TRADE = f"""trade AS (SELECT dataset, label_type, {SQL_NAME} AS model, epsilon, {r4('f1_macro')} AS score,
  {r4('roc_auc')} AS auc, {r4('mcc')} AS mcc, {_LOSS} AS loss_abs, {_PCT} AS loss_pct
  FROM results JOIN lr USING (dataset, label_type) WHERE epsilon IS NOT NULL)"""


@query(FULL + ", " + LR + ", " + _TRADE + " SELECT * FROM trade")
def tradeoff_table(spark: SparkSession, sf: str) -> DataFrame:
    return reports.tradeoff_table(results(spark, sf))


@query(PLAIN + ", " + LR + ", " + _TRADE + """ SELECT *, CASE WHEN abs(loss_pct) <= 5 THEN 'green'
WHEN abs(loss_pct) <= 15 THEN 'yellow' WHEN abs(loss_pct) > 15 THEN 'red' END AS band FROM trade""")
def loss_bands(spark: SparkSession, sf: str) -> DataFrame:
    return reports.loss_bands(reports.tradeoff_table(results(spark, sf, auc=False)))


@query(FULL + f"""SELECT dataset, label_type, model_name, epsilon, {', '.join(f'{r4(m)} AS {m}' for m in evaluate.SCALARS)}
FROM results""")
def summarise_results(spark: SparkSession, sf: str) -> DataFrame:
    flat = evaluate.summarise(results(spark, sf))
    return flat.select("dataset", "label_type", "model_name", "epsilon", *[rnd(m, 4).alias(m) for m in evaluate.SCALARS])


@query(PLAIN + ", " + LR + ", " + BEST + f"""SELECT dataset, label_type, base_model AS best_model,
{r4('best.base')} AS best_f1, {r4('lr.base')} AS lr_f1, {SQL_NAME} AS model, epsilon, {r4('f1_macro')} AS f1_macro,
{I.sql_round('100e0 * (lr.base - f1_macro) / lr.base', 1)} AS loss_pct,
100e0 * (lr.base - f1_macro) / lr.base <= 5 AS within_5pct
FROM results JOIN lr USING (dataset, label_type) JOIN best USING (dataset, label_type) WHERE epsilon IS NOT NULL""")
def key_findings(spark: SparkSession, sf: str) -> DataFrame:
    return reports.key_findings(results(spark, sf, auc=False))


_VIABLE = """viable AS (SELECT dataset, label_type, min(epsilon) FILTER ((base - f1_macro) / base < 0.05) AS min_eps_5pct,
  min(epsilon) FILTER ((base - f1_macro) / base < 0.10) AS min_eps_10pct
  FROM results JOIN best USING (dataset, label_type) WHERE model_name = 'dp_sgd' GROUP BY ALL)"""


@query(PLAIN + ", " + BEST + ", " + _VIABLE + f"""SELECT dataset, label_type, family, model_name, epsilon,
{r4('f1_macro')} AS score, CASE WHEN family <> 'Baseline' THEN
{I.sql_round('100e0 * (f1_macro - base) / base', 1)} END AS delta_pct, min_eps_5pct FROM (
  SELECT *, {SQL_FAMILY} AS family, row_number() OVER (PARTITION BY dataset, label_type, {SQL_FAMILY}
  ORDER BY f1_macro DESC, model_name, epsilon) AS frn FROM results) JOIN best USING (dataset, label_type)
LEFT JOIN viable USING (dataset, label_type) WHERE frn = 1""")
def executive_summary(spark: SparkSession, sf: str) -> DataFrame:
    return reports.executive_summary(results(spark, sf, auc=False))


_DEG = ("f1_macro", "roc_auc", "mcc", "detection_rate")


@query(FULL + f""", top AS (SELECT dataset, label_type, {', '.join(f'max(coalesce({m}, 0)) AS t_{m}' for m in _DEG)}
FROM results WHERE epsilon IS NULL GROUP BY ALL) SELECT dataset, label_type, {SQL_NAME} AS model, epsilon, {', '.join(
    f"CASE WHEN t_{m} > 0 THEN {r4(f'100e0 * (t_{m} - coalesce({m}, 0)) / t_{m}')} ELSE 0e0 END AS drop_{m}" for m in _DEG)}
FROM results JOIN top USING (dataset, label_type) WHERE epsilon IS NOT NULL""")
def degradation_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return reports.degradation_matrix(results(spark, sf))


_H2H = f"""h2h AS (SELECT l.dataset, l.label_type, l.epsilon, {r4('l.f1_macro')} AS lr_score, {r4('s.f1_macro')} AS sgd_score,
  {r4('l.roc_auc')} AS lr_auc, {r4('s.roc_auc')} AS sgd_auc, {r4('l.mcc')} AS lr_mcc, {r4('s.mcc')} AS sgd_mcc,
  {r4('l.false_positive_rate')} AS lr_fpr, {r4('s.false_positive_rate')} AS sgd_fpr,
  CASE WHEN s.f1_macro > l.f1_macro THEN 'DP-SGD' WHEN l.f1_macro > s.f1_macro THEN 'DP-LR' ELSE 'Tie' END AS winner
  FROM results l JOIN results s ON l.dataset = s.dataset AND l.label_type = s.label_type AND l.epsilon = s.epsilon
  WHERE l.model_name = 'dp_logistic_regression' AND s.model_name = 'dp_sgd')"""


@query(FULL + ", " + _H2H + " SELECT * FROM h2h")
def head_to_head(spark: SparkSession, sf: str) -> DataFrame:
    return reports.head_to_head(results(spark, sf))


@query(PLAIN + ", " + _H2H + " SELECT dataset, label_type, winner, count(*) AS n_epsilons FROM h2h GROUP BY ALL")
def win_counts(spark: SparkSession, sf: str) -> DataFrame:
    return reports.win_counts(reports.head_to_head(results(spark, sf, auc=False)))


@query(base(orders=True, auc=False) + """SELECT *, CASE WHEN sgd_wins > lr_wins THEN 'DP-SGD'
WHEN lr_wins > sgd_wins THEN 'DP-LR' ELSE 'tied' END AS overall FROM (
SELECT l.dataset, l.label_type, count(*) FILTER (s.f1_macro > l.f1_macro + 0.001) AS sgd_wins,
count(*) FILTER (l.f1_macro > s.f1_macro + 0.001) AS lr_wins,
count(*) FILTER (s.f1_macro <= l.f1_macro + 0.001 AND l.f1_macro <= s.f1_macro + 0.001) AS ties,
count(*) FILTER (l.epsilon <= 0.5) AS n_low, count(*) FILTER (l.epsilon <= 0.5 AND s.f1_macro > l.f1_macro + 0.001) AS sgd_low_wins,
count(*) FILTER (l.epsilon >= 1) AS n_high, count(*) FILTER (l.epsilon >= 1 AND s.f1_macro > l.f1_macro + 0.001) AS sgd_high_wins
FROM results l JOIN results s ON l.dataset = s.dataset AND l.label_type = s.label_type AND l.epsilon = s.epsilon
WHERE l.model_name = 'dp_logistic_regression' AND s.model_name = 'dp_sgd' GROUP BY ALL)""")
def head_to_head_regimes(spark: SparkSession, sf: str) -> DataFrame:
    return reports.head_to_head_regimes(results(spark, sf, orders=True, auc=False))


# -- budget, time, operating points ---------------------------------------------

@query(FULL + f"""SELECT dataset, label_type, epsilon AS target_epsilon, {r4('actual_epsilon')} AS actual_epsilon,
{I.sql_round('100e0 * actual_epsilon / epsilon', 1)} AS used_pct, {r4('epsilon - actual_epsilon')} AS unused,
{r4('f1_macro')} AS f1_macro, {r4('roc_auc')} AS roc_auc, {I.sql_round('train_time_s', 1)} AS train_time_s
FROM results WHERE model_name = 'dp_sgd'""")
def budget_utilisation(spark: SparkSession, sf: str) -> DataFrame:
    return reports.budget_utilisation(results(spark, sf))


@query(base(orders=True, auc=False) + f"""SELECT dataset, label_type, model_name, count(*) AS n_runs,
{I.sql_round('sum(train_time_s)', 2)} AS total_s, {I.sql_round('avg(train_time_s)', 2)} AS mean_s
FROM results GROUP BY ALL""")
def train_time_summary(spark: SparkSession, sf: str) -> DataFrame:
    return reports.train_time_summary(results(spark, sf, orders=True, auc=False))


@query(PLAIN + f"""SELECT dataset, label_type, {SQL_LABEL} AS model, {SQL_FAMILY} AS type, epsilon,
{r4('false_positive_rate')} AS fpr, {r4('detection_rate')} AS dr,
{r4(f"{r4('false_positive_rate')} / greatest({r4('detection_rate')}, 1e-9)")} AS fpr_dr_ratio FROM results
WHERE false_positive_rate IS NOT NULL""")
def fpr_dr_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return reports.fpr_dr_ranking(results(spark, sf, auc=False))


@query(PLAIN + f"""SELECT dataset, label_type, {SQL_FAMILY} AS type, epsilon, {SQL_LABEL} AS label,
{I.sql_round('precision_macro')} AS "precision", {I.sql_round('recall_macro')} AS recall FROM results""")
def pr_points(spark: SparkSession, sf: str) -> DataFrame:
    return reports.precision_recall_points(results(spark, sf, auc=False))


@query(FULL + " UNION ALL ".join(
    f"SELECT dataset, label_type, {SQL_TITLE} AS model, '{m}' AS metric, {r4(m)} AS value FROM results "
    f"WHERE epsilon IS NULL AND {m} IS NOT NULL" for m in reports.HEAT_METRICS))
def metric_long(spark: SparkSession, sf: str) -> DataFrame:
    return reports.metric_long(results(spark, sf))


@query(FULL + f"""SELECT dataset, label_type, {SQL_TITLE} AS model, {', '.join(
    f'{r4(m)} AS {m}' for m in reports.HEAT_METRICS)} FROM results WHERE epsilon IS NULL""")
def metric_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return reports.metric_matrix(results(spark, sf))


# -- findings -----------------------------------------------------------------------

@query(base(orders=True, auc=False) + ", " + BEST + f"""SELECT dataset, label_type, model_name AS best_model, epsilon,
{r4('f1_macro')} AS score, base_model, {r4('base')} AS base,
CASE WHEN epsilon IS NOT NULL THEN {r4('f1_macro - base')} END AS gap FROM (SELECT *, row_number() OVER (
PARTITION BY dataset, label_type ORDER BY f1_macro DESC, model_name, epsilon) AS frn FROM results)
JOIN best USING (dataset, label_type) WHERE frn = 1""")
def best_overall(spark: SparkSession, sf: str) -> DataFrame:
    return reports.best_overall(results(spark, sf, orders=True, auc=False))


@query(base(orders=True, auc=False) + ", " + BEST + f"""SELECT dataset, label_type, max_epsilon, {r4('cost')} AS cost_pct,
CASE WHEN cost <= 2 THEN 'negligible' WHEN cost <= 5 THEN 'low' WHEN cost <= 15 THEN 'moderate' ELSE 'high' END AS verdict
FROM (SELECT dataset, label_type, max(epsilon) AS max_epsilon,
  100e0 * (any_value(base) - arg_max(f1_macro, epsilon)) / any_value(base) AS cost
  FROM results JOIN best USING (dataset, label_type) WHERE model_name = 'dp_sgd' GROUP BY ALL)""")
def privacy_cost(spark: SparkSession, sf: str) -> DataFrame:
    return reports.privacy_cost(results(spark, sf, orders=True, auc=False))


@query(base(orders=True, auc=False) + ", " + BEST + ", " + _VIABLE + " SELECT * FROM viable")
def min_viable_epsilon(spark: SparkSession, sf: str) -> DataFrame:
    return reports.min_viable_epsilon(results(spark, sf, orders=True, auc=False))


_STEPS = """steps AS (SELECT dataset, label_type, model_name, epsilon, f1_macro AS score,
  lag(epsilon) OVER w AS prev_epsilon, f1_macro - lag(f1_macro) OVER w AS gain,
  row_number() OVER (PARTITION BY dataset, label_type, model_name ORDER BY epsilon DESC) AS from_end
  FROM results WHERE epsilon IS NOT NULL WINDOW w AS (PARTITION BY dataset, label_type, model_name ORDER BY epsilon))"""


@query(base(orders=True, auc=False) + ", " + _STEPS + f"""SELECT dataset, label_type, model_name,
prev_epsilon AS from_epsilon, epsilon AS to_epsilon, {r4('gain')} AS gain FROM (SELECT *, row_number() OVER (
PARTITION BY dataset, label_type, model_name ORDER BY gain DESC, epsilon) AS rn FROM steps WHERE gain > 0.005)
WHERE rn = 1""")
def sharpest_transition(spark: SparkSession, sf: str) -> DataFrame:
    return reports.sharpest_transition(results(spark, sf, orders=True, auc=False))


@query(base(orders=True, auc=False) + ", " + _STEPS + f"""SELECT dataset, label_type, model_name,
{r4('a')} AS score_first, {r4('b')} AS score_last, {r4('b - a')} AS score_range,
CASE WHEN b - a < 0.05 THEN 'narrow' WHEN b - a < 0.2 THEN 'moderate' ELSE 'wide' END AS band,
tail < 0.005 AS plateau, CASE WHEN tail < 0.005 THEN third END AS plateau_from FROM (
SELECT dataset, label_type, model_name, arg_min(score, epsilon) AS a, arg_max(score, epsilon) AS b,
max(abs(gain)) FILTER (from_end <= 3) AS tail, max(epsilon) FILTER (from_end = 3) AS third FROM steps GROUP BY ALL)""")
def noise_floor(spark: SparkSession, sf: str) -> DataFrame:
    return reports.noise_floor(results(spark, sf, orders=True, auc=False))


@query(base(orders=True, auc=False) + ", " + BEST + ", " + _VIABLE + f"""
SELECT dataset, label_type, {I.sql_case({m: m.replace('_', ' ').title() for m in I.BASELINE_MODELS}, 'base_model', 'NULL')}
AS best_baseline, {r4('base')} AS best_f1, n_dp_lr, n_dp_rf, n_dp_sgd, min_eps_10pct FROM best
JOIN viable USING (dataset, label_type) JOIN (SELECT dataset, label_type,
count(*) FILTER (model_name = 'dp_logistic_regression') AS n_dp_lr, count(*) FILTER (model_name = 'dp_random_forest') AS n_dp_rf,
count(*) FILTER (model_name = 'dp_sgd') AS n_dp_sgd FROM results GROUP BY ALL) USING (dataset, label_type)""")
def overview(spark: SparkSession, sf: str) -> DataFrame:
    return reports.overview(results(spark, sf, orders=True, auc=False))


# -- result store --------------------------------------------------------------------

@query("""SELECT user_id, event_type, value, event_id AS version FROM (SELECT *, row_number() OVER (
PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1""")
def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    e = I.read(spark, sf, "events").select("user_id", "event_type", "value", F.col("event_id").alias("version"))
    old, new = e.where("value <= 40"), e.where("value > 40")
    return ledger.upsert(old, new, ["user_id", "event_type"])


_STORE = "run_id, dataset, label_type, model_name, epsilon, split"


@query(base(auc=False) + f"""SELECT {_STORE}, {r4('f1_macro')} AS f1_macro,
CASE WHEN model_name = 'dp_sgd' THEN 2 ELSE 1 END AS version FROM results""")
def upsert_runs(spark: SparkSession, sf: str) -> DataFrame:
    res = results(spark, sf, auc=False)
    first = res.withColumn("version", F.lit(1)).withColumn("f1_macro", F.lit(0.0) + F.when(
        F.col("model_name") != "dp_sgd", F.col("f1_macro")))
    again = res.where("model_name = 'dp_sgd'").withColumn("version", F.lit(2))
    merged = ledger.upsert(first, again)
    return merged.select("run_id", "dataset", "label_type", "model_name", "epsilon", "split",
                         rnd("f1_macro", 4).alias("f1_macro"), "version")


@query(base(auc=False) + f"""SELECT {_STORE}, {r4('f1_macro')} AS f1_macro, {r4('mcc')} AS mcc,
CASE WHEN epsilon IS NULL THEN 1 WHEN model_name = 'dp_sgd' THEN 3 ELSE 2 END AS version FROM results""")
def result_store(spark: SparkSession, sf: str) -> DataFrame:
    root = f"{shared_dir(spark).rstrip('/')}/results-{uuid.uuid4().hex}"
    res = results(spark, sf, auc=False)
    for part in (res.where("epsilon IS NULL"), res.where("epsilon IS NOT NULL"), res.where("model_name = 'dp_sgd'")):
        ledger.save(part, root, RESULT_SCHEMA)
    return ledger.load(spark, root, RESULT_SCHEMA).select(
        "run_id", "dataset", "label_type", "model_name", "epsilon", "split", rnd("f1_macro", 4).alias("f1_macro"),
        rnd("mcc", 4).alias("mcc"), F.col("version").cast("int").alias("version"))


@query(PLAIN + f"SELECT {_STORE}, {r4('f1_macro')} AS f1_macro FROM results")
def combine_runs(spark: SparkSession, sf: str) -> DataFrame:
    res = results(spark, sf, auc=False).withColumn("version", F.lit(1))
    parts = [res.where("epsilon IS NULL")] + [res.where(F.col("model_name") == m) for m in I.DP_MODELS]
    return ledger.combine(*parts).select("run_id", "dataset", "label_type", "model_name", "epsilon", "split",
                                         rnd("f1_macro", 4).alias("f1_macro"))


@query(PLAIN + f""", done AS (SELECT DISTINCT model_name, epsilon FROM results WHERE f1_macro > 0.55)
SELECT r.model_name, count(*) AS n_expected, count(d.model_name) AS n_trained,
count(d.model_name) = count(*) AS complete FROM runs r LEFT JOIN done d
ON r.model_name = d.model_name AND r.epsilon IS NOT DISTINCT FROM d.epsilon GROUP BY 1""")
def pipeline_status(spark: SparkSession, sf: str) -> DataFrame:
    done = results(spark, sf, auc=False).where("f1_macro > 0.55")
    return ledger.pipeline_status(done, EPSILON_GRID)


# -- data overview -----------------------------------------------------------------------

def subset(spark: SparkSession, sf: str) -> DataFrame:
    return I.labelled_rows(spark, sf).select("split", "label_multiclass", F.col("y").alias("label_binary"))


SUBSET = ctes(I.sql_rows())


@query(SUBSET + """SELECT 'split' AS kind, split AS value, count(*) AS n FROM rows GROUP BY 2
UNION ALL SELECT 'class', label_multiclass, count(*) FROM rows GROUP BY 2
UNION ALL SELECT 'binary', CAST(y AS VARCHAR), count(*) FROM rows GROUP BY 2
UNION ALL SELECT 'total', 'rows', count(*) FROM rows UNION ALL SELECT 'total', 'features', 4""")
def subset_stats(spark: SparkSession, sf: str) -> DataFrame:
    return reports.subset_stats(subset(spark, sf), len(I.FLOW_FEATURES))


@query(SUBSET + f"""SELECT CASE WHEN b >= a THEN 'Benign' ELSE 'Attack' END AS majority,
{r4('greatest(a, b) / CAST(least(a, b) AS DOUBLE)')} AS imbalance, b AS n_benign, a AS n_attack,
{r4('100e0 * b / (a + b)')} AS benign_pct, {r4('100e0 * a / (a + b)')} AS attack_pct,
greatest(a, b) / CAST(least(a, b) AS DOUBLE) > 5 AS high
FROM (SELECT count(*) FILTER (y = 0) AS b, count(*) FILTER (y = 1) AS a FROM rows)""")
def imbalance(spark: SparkSession, sf: str) -> DataFrame:
    return reports.class_imbalance(subset(spark, sf))


@query(SUBSET + """SELECT split, y AS label_binary, label_multiclass, count(*) AS n_rows FROM rows
GROUP BY GROUPING SETS ((split, y), (split, label_multiclass))""")
def split_class_counts(spark: SparkSession, sf: str) -> DataFrame:
    return reports.split_class_counts(subset(spark, sf))


@query(SUBSET + f"""SELECT split, count(*) AS n_rows, {r4('100e0 * count(*) / sum(count(*)) OVER ()')} AS share_pct
FROM rows GROUP BY 1""")
def split_shares(spark: SparkSession, sf: str) -> DataFrame:
    return reports.split_shares(subset(spark, sf))


_NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_PROFILE = "profile AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, avg({c}) AS mean, stddev_samp({c}) AS std_dev, median({c}) AS median, min({c}) AS min, "
    f"max({c}) AS max, stddev_samp({c}) / greatest(abs(avg({c})), 1e-9) * 100 AS cv_pct FROM lineitem"
    for c in _NUMERIC) + ")"


@query("WITH " + _PROFILE + " SELECT feature, " + ", ".join(
    f"{r4(c)} AS {c}" for c in ("mean", "std_dev", "median", "min", "max", "cv_pct")) + " FROM profile")
def feature_profile(spark: SparkSession, sf: str) -> DataFrame:
    p = reports.feature_profile(I.read(spark, sf, "lineitem"), _NUMERIC)
    return p.select("feature", *[rnd(c, 4).alias(c) for c in ("mean", "std_dev", "median", "min", "max", "cv_pct")])


@query("WITH " + _PROFILE + f" SELECT feature, {r4('cv_pct')} AS cv_pct FROM profile ORDER BY cv_pct DESC LIMIT 2")
def top_features(spark: SparkSession, sf: str) -> DataFrame:
    p = reports.feature_profile(I.read(spark, sf, "lineitem"), _NUMERIC)
    return reports.top_features(p, "cv_pct", 2).select("feature", rnd("cv_pct", 4).alias("cv_pct"))


@query("""WITH means AS (SELECT i, log10(greatest(abs(avg(CAST(embedding[i] AS DOUBLE))), 1e-9)) AS v
FROM embeddings, generate_series(1, 64) g(i) GROUP BY 1),
edged AS (SELECT v, min(v) OVER () AS lo, max(v) OVER () AS hi FROM means)
SELECT CAST(least(floor((v - lo) / ((hi - lo) / 30)), 29) AS INTEGER) AS bin,
round(min(lo + least(floor((v - lo) / ((hi - lo) / 30)), 29) * ((hi - lo) / 30)), 4) AS low, count(*) AS n_features
FROM edged GROUP BY 1""")
def mean_histogram(spark: SparkSession, sf: str) -> DataFrame:
    long = I.read(spark, sf, "embeddings").select(F.posexplode("embedding").alias("feature", "value"))
    means = long.groupBy("feature").agg(F.avg(F.col("value").cast("double")).alias("mean"))
    return reports.mean_histogram(means).withColumn("low", F.round("low", 4))
