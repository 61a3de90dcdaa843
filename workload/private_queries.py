"""Private forests, privacy accounting, trained models."""

from __future__ import annotations

import uuid
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentinel.functions.cols import rnd
from sentinel.functions.storage import cut_lineage, shared_dir
from sentinel.operators import accountant, baselines, boosting, dp_forest, dp_linear, dp_mlp, scale
from sentinel.operators.metrics import evaluate
from sentinel.operators.sample import add_split
from sentinel.operators.scale import norm_bound
from sentinel.plans import evaluate as evaluate_runs
from sentinel.plans import train
from sentinel.schema import DEFAULTS, EPSILON_GRID
from sentinel.sources import ledger, models
from workload import inputs as I
from workload.registry import ctes, query

N_CLASSES = len(I.CLASSES)
FOREST = dp_forest.random_forest_structure(len(I.FLOW_FEATURES))


# -- private forest ---------------------------------------------------------------

def coded_flows(spark: SparkSession, sf: str) -> DataFrame:
    """Flows with the class code, split and the four features."""
    code = F.array_position(F.array(*[F.lit(c) for c in I.CLASSES]), F.col("label_multiclass")) - 1
    return I.flows(spark, sf).select(
        "*", I.split_of("events", "row_id").alias("split"), code.cast("int").alias("code")).select(
        "row_id", "split", "code", *I.FLOW_FEATURES)


def forest_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, tuple]:
    """The rows, and the forest's inputs with their bounds."""
    rows = cut_lineage(coded_flows(spark, sf))  # read by the bounds, the training and the scoring
    bounds = scale.feature_bounds(rows.where("split = 'train'"), I.FLOW_FEATURES)
    found = {r["feature"]: (round(r["lower"], 6), round(r["upper"], 6)) for r in bounds.collect()}
    low, high = ([found[f][i] for f in I.FLOW_FEATURES] for i in (0, 1))
    return rows, (I.FLOW_FEATURES, low, high)


def _counts(rows: DataFrame, bounded: tuple) -> DataFrame:
    fit = rows.where("split = 'train'")
    return dp_forest.leaf_counts(fit, FOREST, "row_id", "code", N_CLASSES, *bounded, I.SEED)


def _sql_leaf(tree: int) -> str:
    inner = (1 << FOREST.depth) - 1

    def node(i: int) -> str:
        if i >= inner:
            return str(i - inner)
        f = I.FLOW_FEATURES[FOREST.features[tree][i]]
        at = f"lo_{f} + {FOREST.positions[tree][i]!r}e0 * (hi_{f} - lo_{f})"
        return f"CASE WHEN {f} > {at} THEN {node(2 * i + 2)} ELSE {node(2 * i + 1)} END"

    return node(0)


_CODE = "CASE label_multiclass " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(I.CLASSES)) + " END"
_BOUNDS = "bounds AS (SELECT " + ", ".join(
    f"round(l_{f} - (h_{f} - l_{f}) * 0.1e0, 6) AS lo_{f}, round(h_{f} + (h_{f} - l_{f}) * 0.1e0, 6) AS hi_{f}"
    for f in I.FLOW_FEATURES) + " FROM (SELECT " + ", ".join(
    f"quantile_cont({f}, 0.01) AS l_{f}, quantile_cont({f}, 0.99) AS h_{f}" for f in I.FLOW_FEATURES) + \
    " FROM coded WHERE split = 'train'))"
_CODED = f"""coded AS (SELECT row_id, {_CODE} AS code, {', '.join(I.FLOW_FEATURES)},
  {I.SQL_SPLIT.format(u=I.sql_uniform('part', "'events'", 'row_id'))} AS split FROM flows)"""
_LEAVES = "leaves AS (SELECT row_id, code, split, t AS tree, CASE t " + " ".join(
    f"WHEN {t} THEN {_sql_leaf(t)}" for t in range(FOREST.n_trees)) + \
    f" END AS leaf FROM coded CROSS JOIN bounds CROSS JOIN range({FOREST.n_trees}) r(t))"
_COUNTS = f"""counts AS (SELECT g.tree, g.leaf, g.class, coalesce(c.n, 0) AS n FROM (
  SELECT t AS tree, l AS leaf, k AS class FROM range({FOREST.n_trees}) a(t) CROSS JOIN range({FOREST.n_leaves}) b(l)
  CROSS JOIN range({N_CLASSES}) d(k)) g LEFT JOIN (SELECT tree, leaf, code AS class, count(*) AS n FROM leaves
  WHERE split = 'train' AND tree = floor({I.sql_uniform('tree', 'row_id')} * {FOREST.n_trees}) GROUP BY ALL) c
  USING (tree, leaf, class))"""
_EPS = ", ".join(f"({i}, {e!r}e0)" for i, e in enumerate(EPSILON_GRID))
_LABELS = f"""scored AS (SELECT epsilon, tree, leaf, class,
  n - ln(1e0 - {I.sql_uniform('leaf', 'step', 'tree', 'leaf', 'class')}) * 2e0 / epsilon AS score
  FROM counts CROSS JOIN (VALUES {_EPS}) e(step, epsilon)),
labels0 AS (SELECT *, row_number() OVER (PARTITION BY epsilon, tree, leaf ORDER BY score DESC, class) AS rn FROM scored),
leaf_labels AS (SELECT epsilon, tree, leaf, class AS label, score FROM labels0 WHERE rn = 1)"""
FOREST_SQL = ctes(I.SQL_FLOWS, _CODED, _BOUNDS, _LEAVES, _COUNTS)


@query(FOREST_SQL + """SELECT CAST(tree AS INTEGER) AS tree, CAST(leaf AS INTEGER) AS leaf,
CAST(class AS INTEGER) AS class, n FROM counts""")
def dp_forest_leaf_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _counts(*forest_inputs(spark, sf))


_PICK = f"""CAST(tree AS INTEGER) AS tree, CAST(leaf AS INTEGER) AS leaf, CAST(label AS INTEGER) AS label,
{I.sql_round('score', 4)} AS score FROM leaf_labels"""


@query(FOREST_SQL + ", " + _LABELS + f"SELECT epsilon, {_PICK}")
def dp_forest_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return dp_forest.noisy_labels(_counts(*forest_inputs(spark, sf)), EPSILON_GRID, I.SEED).withColumn("score", rnd("score", 4))


_VOTES = f"""votes AS (SELECT epsilon, row_id, split, code, label, count(*) AS v FROM leaves JOIN leaf_labels
  USING (tree, leaf) WHERE split <> 'train' GROUP BY ALL),
picked AS (SELECT epsilon, row_id, split, code, label FROM (SELECT *, row_number() OVER (
  PARTITION BY epsilon, row_id ORDER BY v DESC, label) AS rn FROM votes) WHERE rn = 1)"""


@query(FOREST_SQL + ", " + _LABELS + ", " + _VOTES + f"""SELECT epsilon, split, count(*) AS n_rows,
{I.sql_round('avg(CASE WHEN code = label THEN 1e0 ELSE 0e0 END)')} AS accuracy FROM picked GROUP BY ALL""")
def dp_forest_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    preds = forest_predictions(spark, sf)
    return preds.groupBy("epsilon", "split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        rnd(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")), 6).alias("accuracy"))


def forest_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of the private forest on val and test rows, at every epsilon."""
    rows, bounded = forest_inputs(spark, sf)
    labels = dp_forest.noisy_labels(_counts(rows, bounded), EPSILON_GRID, I.SEED)
    held = dp_forest.route(rows.where("split <> 'train'"), FOREST, *bounded)
    return dp_forest.predict(held.withColumn("y_true", F.col("code")), FOREST, labels, N_CLASSES)


def _store(spark: SparkSession, sf: str) -> str:
    """Scaler and private forests of every budget, saved as parameter vectors."""
    rows, bounded = forest_inputs(spark, sf)
    labels = dp_forest.noisy_labels(_counts(rows, bounded), EPSILON_GRID, I.SEED)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("tree", "leaf", "label"))), lambda s: s["label"].cast("double"))
    forests = labels.groupBy("epsilon").agg(ordered.alias("values")).select(
        F.lit("dp_random_forest").alias("model_name"), "epsilon", F.lit(None).cast("array<string>").alias("names"), "values")
    pairs = F.array_sort(F.collect_list(F.struct("feature", "mean")))
    scaler = scale.fit_scaler(rows.where("split = 'train'"), I.FLOW_FEATURES).agg(pairs.alias("p")).select(
        F.lit("scaler").alias("model_name"), F.lit(None).cast("double").alias("epsilon"), F.col("p.feature").alias("names"), F.col("p.mean").alias("values"))
    root = f"{shared_dir(spark).rstrip('/')}/models-{uuid.uuid4().hex}"
    meta = F.lit("events").alias("dataset"), F.lit("multiclass").alias("label_type")
    ledger.save_parameters(forests.select(*meta, "*"), root)
    ledger.save_parameters(scaler.select(*meta, "*"), root)
    return root


@query(FOREST_SQL + ", " + _LABELS + f"""SELECT 'dp_random_forest' AS model_name, epsilon, tree * {FOREST.n_leaves} + leaf AS position,
CAST(label AS DOUBLE) AS value FROM leaf_labels UNION ALL SELECT 'scaler', NULL, row_number() OVER (ORDER BY feature) - 1, {I.sql_round('mean')}
FROM (""" + " UNION ALL ".join(f"SELECT '{c}' AS feature, avg({c}) AS mean FROM coded WHERE split = 'train'" for c in I.FLOW_FEATURES) + ")")
def model_store(spark: SparkSession, sf: str) -> DataFrame:
    """Parameters read back from the store."""
    stored = ledger.load(spark, _store(spark, sf), ledger.PARAMETER_SCHEMA)
    return stored.select("model_name", "epsilon", F.posexplode("values").alias("position", "value")).select(
        "model_name", "epsilon", F.col("position").cast("bigint").alias("position"), rnd("value", 6).alias("value"))


@query(FOREST_SQL + ", " + _LABELS + """SELECT 'events' AS dataset, 'multiclass' AS label_type, 'dp_random_forest' AS model_name, epsilon,
count(*) AS n_values, count(*) * 8 / 1024e0 AS size_kb FROM leaf_labels GROUP BY epsilon""")
def run_listing(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.stored_models(spark, _store(spark, sf))


_SHARES = ", ".join(f"sum(CASE WHEN label = {c} THEN 1 ELSE 0 END) / 10e0 AS p{c}" for c in range(N_CLASSES))
_SHARE_LONG = " UNION ALL ".join(
    f"SELECT epsilon, split, {c} AS class, p{c} AS score, CASE WHEN code = {c} THEN 1 ELSE 0 END AS hit FROM shares"
    for c in range(N_CLASSES))


def _entry_sql() -> str:
    from workload.metric_queries import SQL_CLASS, SQL_CONF, SQL_SCALARS, sql_auc

    named = lambda s: s.replace("run_id", "epsilon")
    return (
        FOREST_SQL + ", " + _LABELS + ", " + _VOTES + f""",
shares AS (SELECT epsilon, row_id, split, code, {_SHARES} FROM leaves JOIN leaf_labels USING (tree, leaf)
  WHERE split <> 'train' GROUP BY epsilon, row_id, split, code),
held AS (SELECT epsilon, split, code AS y_true, label AS y_pred FROM picked),
{named(SQL_CONF)}, {named(SQL_CLASS)}, {named(SQL_SCALARS)}, long AS ({_SHARE_LONG}),
aucs AS ({sql_auc('long', 'epsilon, split, class', 'score', 'hit')}),
auc AS (SELECT epsilon, split, CASE WHEN count(roc_auc) = count(*) THEN avg(roc_auc) END AS roc_auc FROM aucs GROUP BY ALL)
SELECT epsilon, split, """ + ", ".join(f"{I.sql_round(m)} AS {m}" for m in (
            "accuracy", "f1_macro", "f1_weighted", "precision_macro", "recall_macro", "mcc", "roc_auc")) +
        " FROM sc JOIN auc USING (epsilon, split)")


@query(_entry_sql())
def dp_forest_metrics(spark: SparkSession, sf: str) -> DataFrame:
    suite = evaluate(forest_predictions(spark, sf), ["epsilon", "split"], "multiclass")
    return suite.select("epsilon", "split", *[rnd(m, 6).alias(m) for m in (
        "accuracy", "f1_macro", "f1_weighted", "precision_macro", "recall_macro", "mcc", "roc_auc")])


# -- accounting -----------------------------------------------------------------------


def sql_rdp(source: str, orders: str, name: str = "rdp") -> str:
    """(rate, sigma, alpha, rdp) over the distinct settings of ``source``, by log-sum-exp over k."""
    term = ("lgamma(alpha + 1) - lgamma(k + 1) - lgamma(alpha - k + 1) + CASE WHEN k = alpha THEN 0e0 ELSE "
            "(alpha - k) * ln(1e0 - rate) END + k * ln(rate) + (k * k - k) / (2e0 * sigma * sigma)")
    return f"""{name}_terms AS (SELECT rate, sigma, alpha, {term} AS t FROM (SELECT DISTINCT rate, sigma FROM {source}) s
  CROSS JOIN ({orders}) o(alpha), generate_series(0, alpha) g(k)),
{name} AS (SELECT rate, sigma, alpha, (any_value(m) + ln(sum(exp(t - m)))) / (alpha - 1) AS rdp FROM (
  SELECT *, max(t) OVER (PARTITION BY rate, sigma, alpha) AS m FROM {name}_terms) GROUP BY rate, sigma, alpha)"""


_EPS_AT = "greatest(total + ln((alpha - 1e0) / alpha) - (ln(1e-5) + ln(alpha)) / (alpha - 1e0), 0e0)"


def sql_spent(keys: str, steps: str, orders: str) -> str:
    return f"""{sql_rdp(steps, orders)},
spent AS (SELECT {keys}, min(eps) AS epsilon FROM (SELECT {keys}, {_EPS_AT} AS eps FROM (
  SELECT {keys}, alpha, sum(steps * rdp) AS total FROM {steps} JOIN rdp USING (rate, sigma) GROUP BY ALL))
  GROUP BY {keys})"""


SQL_ORDERS = "SELECT unnest([" + ", ".join(str(a) for a in accountant.ORDERS) + "])"
_PLAN = "(l_discount + 0.01) / 10"
_STEPS = f"""steps AS (SELECT l_suppkey, {I.sql_round(_PLAN, 6)} AS rate, {I.sql_round('0.8e0 + l_tax * 10', 6)} AS sigma,
  count(*) AS steps FROM lineitem GROUP BY ALL)"""


def _steps(spark: SparkSession, sf: str) -> DataFrame:
    """Every order line is one noisy step of its supplier's model."""
    li = I.read(spark, sf, "lineitem").select(
        "l_suppkey", rnd((F.col("l_discount") + 0.01) / 10, 6).alias("rate"),
        rnd(F.lit(0.8) + F.col("l_tax") * 10, 6).alias("sigma"))
    return li.groupBy("l_suppkey", "rate", "sigma").agg(F.count(F.lit(1)).alias("steps"))


@query(ctes(_STEPS, sql_rdp("steps", SQL_ORDERS)) +
       f"SELECT rate, sigma, CAST(alpha AS INTEGER) AS alpha, {I.sql_round('rdp', 8)} AS rdp FROM rdp")
def rdp_curve(spark: SparkSession, sf: str) -> DataFrame:
    return accountant.rdp(_steps(spark, sf)).withColumn("rdp", rnd("rdp", 8))


@query(ctes(_STEPS, sql_spent("l_suppkey", "steps", SQL_ORDERS)) +
       f"SELECT l_suppkey, {I.sql_round('epsilon')} AS epsilon FROM spent")
def rdp_epsilon(spark: SparkSession, sf: str) -> DataFrame:
    spent = accountant.spent_epsilon(_steps(spark, sf), ["l_suppkey"], 1e-5)
    return spent.select("l_suppkey", rnd("epsilon", 6).alias("epsilon"))


_WHOLE = (2, 3, 5, 9, 17, 33)


@query(ctes(_STEPS, sql_rdp("steps", f"SELECT unnest([{', '.join(map(str, _WHOLE))}])")) +
       f"SELECT rate, sigma, CAST(alpha AS DOUBLE) AS alpha, {I.sql_round('rdp', 6)} AS rdp FROM rdp")
def rdp_real_orders(spark: SparkSession, sf: str) -> DataFrame:
    """The series for real orders, taken at whole ones, where a finite sum gives the same."""
    return accountant.rdp_real(_steps(spark, sf), [float(a) for a in _WHOLE]).withColumn("rdp", rnd("rdp", 6))


@query(ctes(_STEPS, sql_spent("l_suppkey", "steps", SQL_ORDERS)) +
       f"SELECT l_suppkey, {I.sql_round('epsilon')} AS whole_epsilon, true AS not_above FROM spent")
def epsilon_real_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Real orders never make the spent epsilon larger."""
    spent = accountant.spent_epsilon(_steps(spark, sf), ["l_suppkey"], 1e-5, real_orders=accountant.REAL_ORDERS)
    return spent.select("l_suppkey", rnd("whole_epsilon", 6).alias("whole_epsilon"), (F.col("epsilon") <= F.col("whole_epsilon")).alias("not_above"))


@query(ctes("""steps AS (SELECT l_returnflag, epoch, 0.01e0 AS rate, 1.1e0 AS sigma,
  CAST(sum(n) OVER (PARTITION BY l_returnflag ORDER BY epoch) AS BIGINT) AS steps FROM (
  SELECT l_returnflag, year(l_shipdate) AS epoch, count(*) AS n FROM lineitem GROUP BY ALL))""",
            sql_spent("l_returnflag, epoch", "steps", SQL_ORDERS)) +
       f"SELECT l_returnflag, epoch, {I.sql_round('epsilon')} AS epsilon FROM spent")
def epsilon_by_epoch(spark: SparkSession, sf: str) -> DataFrame:
    years = I.read(spark, sf, "lineitem").groupBy(
        "l_returnflag", F.year(F.col("l_shipdate").cast("timestamp_ntz")).cast("bigint").alias("epoch")).agg(
        F.count(F.lit(1)).alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("l_returnflag").orderBy("epoch"))
    steps = years.select("l_returnflag", "epoch", F.lit(0.01).alias("rate"), F.lit(1.1).alias("sigma"),
                         so_far.alias("steps"))
    return accountant.spent_epsilon(steps, ["l_returnflag", "epoch"], 1e-5).select(
        "l_returnflag", "epoch", rnd("epsilon", 6).alias("epsilon"))


SIGMAS = tuple(round(0.4 * 1.3 ** i, 4) for i in range(24))
_TARGETS = ", ".join(f"({e!r}e0)" for e in EPSILON_GRID)
_SIGMA_ROWS = ", ".join(f"({s!r}e0)" for s in SIGMAS)


@query(ctes(f"""tried AS (SELECT l_returnflag, least(1e0, 256e0 / n) AS rate, sigma, CAST(floor(n * 20e0 / 256e0) AS BIGINT)
  AS steps FROM (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1) CROSS JOIN (VALUES {_SIGMA_ROWS}) v(sigma))""",
            sql_spent("l_returnflag, sigma", "tried", SQL_ORDERS)) +
       f"""SELECT l_returnflag, target, min(sigma) FILTER (epsilon <= target) AS sigma,
{I.sql_round('arg_min(epsilon, sigma) FILTER (epsilon <= target)', 5)} AS epsilon
FROM spent CROSS JOIN (VALUES {_TARGETS}) t(target) GROUP BY ALL""")
def noise_calibration(spark: SparkSession, sf: str) -> DataFrame:
    n = I.read(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    plans = n.select("l_returnflag", F.least(F.lit(1.0), F.lit(256.0) / F.col("n")).alias("rate"),
                     F.floor(F.col("n") * 20.0 / 256.0).alias("steps"))
    return accountant.calibrate_noise(plans, ["l_returnflag"], EPSILON_GRID, 1e-5, SIGMAS).withColumn(
        "epsilon", rnd("epsilon", 5))


# -- trained models (no SQL equivalent) -------------------------------------------------

def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings with a split and two labels that depend on the vector: a sign and an argmax."""
    e = I.read_spread(spark, sf, "embeddings")
    u = I.uniform(I.SEED, "part", "vec_id")
    first = F.slice("embedding", 1, 5)
    return e.select(
        F.col("vec_id").alias("row_id"), F.col("embedding").alias("features"),
        (F.get("embedding", F.lit(0)) + F.get("embedding", F.lit(1)) > 0).cast("int").alias("y"),
        (F.array_position(first, F.array_max(first)) - 1).cast("int").alias("y5"),
        F.when(u < 0.6, "train").when(u < 0.8, "val").otherwise("test").alias("split"))


def _scored(preds: DataFrame, keys, label: str, kind: str) -> DataFrame:
    suite = evaluate(preds.withColumn("y_true", F.col(label)), keys, kind)
    return suite.select(*keys, *[rnd(m, 4).alias(m) for m in ("accuracy", "f1_macro", "mcc", "roc_auc")])


@query()
def logreg(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors(spark, sf)
    out = None
    for label, kind in (("y", "binary"), ("y5", "multiclass")):
        model = baselines.train_logistic(rows.where("split = 'train'"), "features", label)
        part = _scored(baselines.predict(model, rows, "features"), ["split"], label, kind).withColumn(
            "label_type", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


@query()
def random_forest(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors(spark, sf)
    model = baselines.train_forest(rows.where("split = 'train'"), "features", "y5")
    return _scored(baselines.predict(model, rows, "features"), ["split"], "y5", "multiclass")


@query()
def gbt(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors(spark, sf)
    model = baselines.train_boosted(rows.where("split = 'train'"), "features", "y", 2)
    return _scored(baselines.predict(model, rows, "features"), ["split"], "y", "binary")


@query()
def gbt_one_vs_rest(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors(spark, sf)
    model = baselines.train_boosted(rows.where("split = 'train'"), "features", "y5", 5, objective="one_vs_rest")
    return _scored(baselines.predict(model, rows, "features"), ["split"], "y5", "multiclass")


@query()
def gbt_multiclass(spark: SparkSession, sf: str) -> DataFrame:
    """Softmax over five classes, 100 rounds of depth 10."""
    rows = vectors(spark, sf)
    model = baselines.train_boosted(rows.where("split = 'train'"), "features", "y5", 5)
    return _scored(baselines.predict(model, rows, "features"), ["split"], "y5", "multiclass")


def _sql_units(value: float) -> str:
    """A number as the whole multiple of 2**-24 that the histograms add."""
    return f"({round(value * (1 << 24))} / 16777216e0)"


_SHARE = 1.0 / N_CLASSES
_CUTS = "cuts AS (SELECT DISTINCT * FROM (" + " UNION ALL ".join(
    f"SELECT {i} AS feature, unnest(quantile_cont({f}, [{', '.join(f'{k}e0 / 64' for k in range(1, 64))}])) AS cut FROM coded WHERE split = 'train'"
    for i, f in enumerate(I.FLOW_FEATURES)) + "))"
_SIDES = "sides AS (" + " UNION ALL ".join(
    f"SELECT {i} AS feature, cut, k AS class, count(*) FILTER ({f} <= cut) AS nl, count(*) FILTER ({f} <= cut AND code = k) AS pl, "
    f"count(*) AS n, count(*) FILTER (code = k) AS p FROM coded CROSS JOIN (SELECT cut FROM cuts WHERE feature = {i}) CROSS JOIN range({N_CLASSES}) c(k) "
    "WHERE split = 'train' GROUP BY ALL" for i, f in enumerate(I.FLOW_FEATURES)) + ")"


@query(ctes(I.SQL_FLOWS, _CODED, _CUTS, _SIDES, f"""sums AS (SELECT *, (nl - pl) * {_sql_units(_SHARE)} + pl * {_sql_units(_SHARE - 1)} AS gl, nl * {_sql_units(2 * _SHARE * (1 - _SHARE))} AS hl,
  (n - p) * {_sql_units(_SHARE)} + p * {_sql_units(_SHARE - 1)} AS g, n * {_sql_units(2 * _SHARE * (1 - _SHARE))} AS h FROM sides)""",
            """gains AS (SELECT *, gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1) AS gain FROM sums WHERE hl >= 1 AND h - hl >= 1)""",
            "picked AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY gain DESC, feature, cut) AS rn FROM gains)") + f"""
SELECT CAST(class AS INTEGER) AS class, CAST(feature AS INTEGER) AS feature, {I.sql_round('cut')} AS threshold, {I.sql_round('gain', 4)} AS gain,
{I.sql_round('-0.3e0 * gl / (hl + 1)')} AS left_value, {I.sql_round('-0.3e0 * (g - gl) / (h - hl + 1)')} AS right_value FROM picked WHERE rn = 1 AND gain > 1e-6""")
def boosted_root_splits(spark: SparkSession, sf: str) -> DataFrame:
    """The first split of each class's first tree in a softmax boosting of the flows, and the values of its two leaves."""
    rows = scale.assemble(coded_flows(spark, sf), I.FLOW_FEATURES).where("split = 'train'")
    table = boosting.nodes(spark, boosting.train(rows, "features", "code", N_CLASSES, rounds=1, depth=1))
    value = {n: F.max(F.when(F.col("node") == n, F.col("value"))) for n in (1, 2)}
    root = lambda c: F.max(F.when((F.col("node") == 0) & (F.col("feature") >= 0), F.col(c)))
    found = table.groupBy(F.col("group").alias("class")).agg(root("feature").alias("feature"), root("threshold").alias("threshold"), root("gain").alias("gain"),
                                                            value[1].alias("left_value"), value[2].alias("right_value")).where("feature IS NOT NULL")
    return found.select("class", "feature", rnd("threshold", 6).alias("threshold"), rnd("gain", 4).alias("gain"), rnd("left_value", 6).alias("left_value"),
                        rnd("right_value", 6).alias("right_value"))


@query()
def feature_importance(spark: SparkSession, sf: str) -> DataFrame:
    rows = scale.assemble(coded_flows(spark, sf), I.FLOW_FEATURES)
    model = baselines.train_forest(rows.where("split = 'train'"), "features", "code")
    return baselines.feature_importances(model, rows, I.FLOW_FEATURES)


@query()
def dp_logreg_sweep(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors(spark, sf)
    fit = rows.where("split = 'train'")
    bound = norm_bound(fit).first()["bound"]
    models = dp_linear.train(fit, "features", "y", 2, bound, seed=I.SEED)
    return _scored(dp_linear.predict(rows, models), ["epsilon", "split"], "y", "binary")


_SPLIT_VECTORS = f"vectors AS (SELECT vec_id, {I.SQL_SPLIT.format(u=I.sql_uniform('part', 'vec_id'))} AS split FROM embeddings)"


def _sound(preds: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per run, and how many of them have probabilities that do not sum to 1 or a class that is not the likeliest."""
    total = F.aggregate("probs", F.lit(0.0), lambda a, v: a + v)
    bad = (F.abs(total - 1) > 1e-9) | (F.get("probs", F.col("y_pred")) < F.array_max("probs"))
    return preds.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(bad).alias("n_bad"))


@query(ctes(_SPLIT_VECTORS) + f"""SELECT epsilon, split, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_bad, 0e0 AS residual
FROM vectors CROSS JOIN (VALUES {_EPS}) e(step, epsilon) GROUP BY ALL""")
def dp_logreg_properties(spark: SparkSession, sf: str) -> DataFrame:
    """Every budget's model scores every row, gives probabilities, and is at its minimum."""
    rows = vectors(spark, sf)
    fit = rows.where("split = 'train'")
    models = dp_linear.train(fit, "features", "y", 2, norm_bound(fit).first()["bound"], seed=I.SEED)
    residuals = spark.createDataFrame(list(zip(models.epsilons, models.residuals)), "epsilon double, residual double")
    return _sound(dp_linear.predict(rows, models), ["epsilon", "split"]).join(residuals, "epsilon").withColumn("residual", rnd("residual", 3))


@query(ctes(_SPLIT_VECTORS) + """SELECT model, split, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_bad
FROM vectors CROSS JOIN (VALUES ('logistic_regression'), ('random_forest')) m(model) GROUP BY ALL""")
def baseline_properties(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors(spark, sf)
    fit = rows.where("split = 'train'")
    found = {"logistic_regression": baselines.train_logistic(fit, "features", "y"), "random_forest": baselines.train_forest(fit, "features", "y")}
    parts = [_sound(baselines.predict(m, rows, "features"), ["split"]).withColumn("model", F.lit(name)) for name, m in found.items()]
    return reduce(DataFrame.unionByName, parts)


@query()
def dp_logreg_multiclass(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors(spark, sf)
    fit = rows.where("split = 'train'")
    bound = norm_bound(fit).first()["bound"]
    models = dp_linear.train(fit, "features", "y5", 5, bound, seed=I.SEED)
    return _scored(dp_linear.predict(rows, models), ["epsilon", "split"], "y5", "multiclass")


@query()
def dp_mlp_training(spark: SparkSession, sf: str) -> DataFrame:
    """The network at every budget, on shared lots."""
    rows = vectors(spark, sf)
    models = dp_mlp.train_sweep(rows.where("split = 'train'"), "row_id", "features", "y", 2, EPSILON_GRID, seed=I.SEED)
    preds = reduce(DataFrame.unionByName, [dp_mlp.predict(rows, m) for m in models.values()])
    spent = spark.createDataFrame([(e, m.actual_epsilon) for e, m in models.items()], "epsilon double, actual double")
    scored = _scored(preds, ["epsilon", "split"], "y", "binary").join(spent, "epsilon")
    return scored.withColumn("actual_epsilon", rnd("actual", 4)).drop("actual")


def _experiment_data(spark: SparkSession, sf: str) -> train.Prepared:
    """Flows with a label that depends on the features, so that the budget's effect shows."""
    hit = F.col("f_value") / 50 + F.col("f_k") / 100 > 1.2
    rows = I.flows(spark, sf).withColumn("label_multiclass", F.when(hit, "DoS").otherwise("BENIGN")).withColumn(
        "label_binary", hit.cast("tinyint"))
    return train.prepare(add_split(rows, "row_id", seed=I.SEED))


@query()
def experiment(spark: SparkSession, sf: str) -> DataFrame:
    """Flows to split, scaling, all six families at full size and all 13 budgets, and their test metrics."""
    preds, runs = train.run_models(_experiment_data(spark, sf), "events", "binary", seed=I.SEED)
    failed = runs.where("status = 'failed'").select("run_id", "error").collect()
    if failed:
        raise RuntimeError(f"runs failed: {failed}")
    res = evaluate_runs.result_rows(preds.where("split = 'test'"), runs)
    return res.select("model_name", "epsilon", "split", *[
        rnd(m, 4).alias(m) for m in ("accuracy", "f1_macro", "mcc", "roc_auc", "false_positive_rate", "detection_rate")])


_STORED = replace(DEFAULTS, epsilons=EPSILON_GRID)
_LIN = len(I.FLOW_FEATURES) + 1


@query(f"""SELECT m.model_name, epsilon, n_parameters, 'trained' AS first_status, 'loaded' AS second_status, true AS untimed,
(SELECT count(*) FROM events) AS n_equal FROM (SELECT 'logistic_regression' AS model_name, CAST(NULL AS DOUBLE) AS epsilon, CAST({_LIN} AS BIGINT) AS n_parameters
UNION ALL SELECT 'dp_random_forest', epsilon, CAST({FOREST.n_trees * FOREST.n_leaves} AS BIGINT) FROM (VALUES {_EPS}) e(step, epsilon)
UNION ALL SELECT 'dp_logistic_regression', epsilon, CAST({_LIN} AS BIGINT) FROM (VALUES {_EPS}) e(step, epsilon)) m""")
def model_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """A sweep that stores its models, and the same sweep again: nothing is trained, and every row gets the same class."""
    data = _experiment_data(spark, sf)
    store = models.ModelStore(spark, f"{shared_dir(spark).rstrip('/')}/models-{uuid.uuid4().hex}")
    families = ("logistic_regression", "dp_logistic_regression", "dp_random_forest")
    runs = [train.run_models(data, "events", "binary", families, _STORED, I.SEED, store) for _ in range(2)]
    (first, one), (second, two) = runs
    key = ["run_id", "row_id"]
    equal = first.select(*key, F.col("y_pred").alias("_a")).join(second.select(*key, F.col("y_pred").alias("_b")), key).groupBy("run_id").agg(
        F.count_if(F.col("_a") == F.col("_b")).alias("n_equal"))
    listed = store.listing().select(F.concat_ws("/", "dataset", "label_type", "model_name", F.col("epsilon").cast("string")).alias("run_id"), "n_parameters")
    both = one.select("run_id", "model_name", "epsilon", F.col("status").alias("first_status")).join(
        two.select("run_id", F.col("status").alias("second_status"), F.col("train_time_s").isNull().alias("untimed")), "run_id")
    return both.join(listed, "run_id").join(equal, "run_id").drop("run_id")
