"""Inputs of the registered queries, derived from the given tables by fixed rules.

Each input exists twice: as a DataFrame and as a SQL common table expression that computes the same
rows. Labels come from event types and order states; nulls, infinities and unparsable texts are set
by row number; predictions of a run are a blend of the true label and a keyed random number, with a
quality that grows with the run's epsilon.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinel.functions.cols import double
from sentinel.functions.rand import uniform
from sentinel.functions.storage import use_all_cores
from sentinel.operators.labels import map_cic_labels
from sentinel.schema import BASELINE_MODELS, CIC_LABELS, DP_MODELS, EPSILON_GRID, UNSW_LABELS

SEED = 42
CLASSES = ("BENIGN", "DoS", "Infiltration", "Unknown", "WebAttack")
EVENT_LABELS = {"view": " Benign ", "click": "DoS attacks-Hulk", "purchase": "Infilteration",
                "signup": "SQL Injection"}
EVENT_CATEGORIES = {"view": "", "click": "DoS", "purchase": " Fuzzers", "signup": "Backdoors"}
ORDER_CLASSES = {"F": "BENIGN", "O": "DoS", "P": "Unknown"}
QUALITY = {"logistic_regression": 0.80, "random_forest": 0.88, "xgboost": 0.90,
           "dp_logistic_regression": 0.78, "dp_random_forest": 0.72, "dp_sgd": 0.86}
HALF_EPSILON = {"dp_logistic_regression": 0.8, "dp_random_forest": 1.5, "dp_sgd": 0.4}
SPEED = {"logistic_regression": 0.6, "random_forest": 0.03, "xgboost": 0.01,
         "dp_logistic_regression": 0.02, "dp_random_forest": 0.01, "dp_sgd": 1.1}


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def read_spread(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """For queries with much work per row; a single small file would keep one core busy."""
    return use_all_cores(read(spark, sf, name))


def run_list(epsilons=EPSILON_GRID) -> list[dict]:
    runs = [dict(model=m, eps=None, q=QUALITY[m]) for m in BASELINE_MODELS]
    runs += [dict(model=m, eps=e, q=round(QUALITY[m] * e / (e + HALF_EPSILON[m]), 4))
             for m in DP_MODELS for e in epsilons]
    for i, r in enumerate(runs):
        r["no"] = i
        r["speed"] = SPEED[r["model"]] * (1 if r["eps"] is None else 1 + r["eps"] / 10)
    return runs


RUNS = run_list()


# -- SQL pieces ---------------------------------------------------------------

def sql_uniform(salt: str, *keys: str, seed: int = SEED) -> str:
    text = ", ".join(["'" + str(seed) + "'", f"'{salt}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"(CAST(('0x' || substr(md5(concat_ws(':', {text})), 1, 13)) AS BIGINT) / 4503599627370496e0)"


def sql_case(values: dict[str, str], expr: str, default: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items())
    return f"CASE {expr} {whens} ELSE {default} END"


def sql_round(expr: str, places: int = 6) -> str:
    return f"(round({expr}, {places}) + 0e0)"


def sql_runs(runs=RUNS) -> str:
    rows = ", ".join(
        f"({r['no']}, '{r['model']}', {'NULL' if r['eps'] is None else repr(r['eps']) + 'e0'}, "
        f"{r['q']!r}e0, {r['speed']!r}e0)" for r in runs)
    return (f"runs AS (SELECT no, model_name, CAST(epsilon AS DOUBLE) AS epsilon, q, speed, "
            f"concat_ws('/', model_name, CAST(no AS VARCHAR)) AS run_id "
            f"FROM (VALUES {rows}) t(no, model_name, epsilon, q, speed))")


SQL_SPLIT = "CASE WHEN {u} < 0.6e0 THEN 'train' WHEN {u} < 0.8e0 THEN 'val' ELSE 'test' END"
SQL_LABEL = sql_case(EVENT_LABELS, "event_type", "event_type")
SQL_CLASS = sql_case(CIC_LABELS, f"lower(trim({SQL_LABEL}))", "'Unknown'")
SQL_BINARY = "CASE WHEN label_multiclass = 'BENIGN' THEN 0 ELSE 1 END"

SQL_FLOWS = f"""flows AS (SELECT event_id AS row_id, trim({SQL_LABEL}) AS label_raw,
  {SQL_CLASS} AS label_multiclass, value AS f_value, CAST(hour(ts) AS DOUBLE) AS f_hour,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS f_k, CAST(user_id % 16 AS DOUBLE) AS f_user
  FROM events)"""

SQL_RAW = f"""raw_flows AS (SELECT event_id, {SQL_LABEL} AS label,
  CASE WHEN event_id % 13 = 0 THEN '10.0.0.1' WHEN event_id % 11 = 0 THEN 'inf'
       WHEN event_id % 7 = 0 THEN NULL ELSE CAST(value AS VARCHAR) END AS flow_value,
  CASE WHEN event_id % 17 = 0 THEN 'nan' ELSE CAST(hour(ts) AS VARCHAR) END AS flow_hour,
  regexp_extract(props, '([0-9]+)', 1) AS flow_k, '10.0.' || CAST(user_id % 16 AS VARCHAR) || '.1' AS src_ip
  FROM events)"""


def sql_float(c: str) -> str:
    return (f"CASE WHEN isinf(TRY_CAST(trim({c}) AS FLOAT)) OR isnan(TRY_CAST(trim({c}) AS FLOAT)) "
            f"THEN NULL ELSE TRY_CAST(trim({c}) AS FLOAT) END")


SQL_CLEAN = f"""cleaned AS (SELECT trim(label) AS label_raw,
  {sql_case(CIC_LABELS, "lower(trim(label))", "'Unknown'")} AS label_multiclass,
  {sql_float('flow_value')} AS flow_value, {sql_float('flow_hour')} AS flow_hour,
  {sql_float('flow_k')} AS flow_k, {sql_float('src_ip')} AS src_ip FROM raw_flows)"""


def sql_rows(orders: bool = False) -> str:
    """Labelled rows with split and the two keyed draws that predictions are made of."""
    part = lambda dataset, table, key, cls: f"""SELECT '{dataset}' AS dataset, {key} AS row_id,
      {cls} AS label_multiclass, {sql_uniform('sig', f"'{dataset}'", key)} AS u1,
      {sql_uniform('noise', f"'{dataset}'", key)} AS u2,
      {SQL_SPLIT.format(u=sql_uniform('part', f"'{dataset}'", key))} AS split FROM {table}"""
    parts = [part("events", "events", "event_id", SQL_CLASS)]
    if orders:
        parts.append(part("orders", "orders", "o_orderkey", sql_case(ORDER_CLASSES, "o_orderstatus", "'Unknown'")))
    return "rows0 AS (" + " UNION ALL ".join(parts) + f"), rows AS (SELECT *, {SQL_BINARY} AS y FROM rows0)"


SQL_PREDS = """preds AS (SELECT dataset || '/' || run_id AS run_id, dataset, 'binary' AS label_type, model_name, epsilon, row_id, split,
  y AS y_true, CASE WHEN p >= 0.5e0 THEN 1 ELSE 0 END AS y_pred, p AS score FROM (
  SELECT *, q * (CASE WHEN y = 1 THEN 0.5e0 + 0.5e0 * u1 ELSE 0.5e0 * u1 END)
          + (1e0 - q) * (u2 * (101 + 7 * no) - floor(u2 * (101 + 7 * no))) AS p
  FROM rows CROSS JOIN runs) s)"""

_CODES = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(CLASSES))
_RAW = [f"(q * (CASE WHEN code = {c} THEN 1e0 ELSE 0e0 END) + (1e0 - q) * "
        f"(u2 * (101 + 7 * no + 31 * {c}) - floor(u2 * (101 + 7 * no + 31 * {c}))))" for c in range(5)]
_TOTAL = " + ".join(f"r{c}" for c in range(5))
_BEST = "greatest(" + ", ".join(f"r{c} / rt" for c in range(5)) + ")"
SQL_MULTI = f"""multi AS (SELECT *, CASE {' '.join(f'WHEN p{c} = best THEN {c}' for c in range(5))} END AS y_pred FROM (
  SELECT *, {', '.join(f'r{c} / rt AS p{c}' for c in range(5))}, {_BEST} AS best FROM (
  SELECT *, 0e0 + {_TOTAL} AS rt FROM (
  SELECT dataset || '/' || run_id AS run_id, dataset, 'multiclass' AS label_type, model_name, epsilon, row_id, split, code AS y_true,
    {', '.join(f'{r} AS r{c}' for c, r in enumerate(_RAW))}
  FROM (SELECT *, CASE label_multiclass {_CODES} END AS code FROM rows) CROSS JOIN runs))))"""


# -- DataFrames -----------------------------------------------------------------

def case(values: dict[str, str], col: str, default: Column) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(F.col(col) == k, v) if out is None else out.when(F.col(col) == k, v)
    return out.otherwise(default)


def hour_of(ts: str) -> Column:
    return F.hour(F.col(ts).cast("timestamp_ntz"))


def flow_k() -> Column:
    return F.regexp_extract("props", "([0-9]+)", 1)


def flows(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled events with four numeric features; row_id is unique."""
    e = read_spread(spark, sf, "events")
    df = e.select(
        F.col("event_id").alias("row_id"), case(EVENT_LABELS, "event_type", F.col("event_type")).alias("label"),
        F.col("value").alias("f_value"), hour_of("ts").cast("double").alias("f_hour"),
        flow_k().cast("double").alias("f_k"), (F.col("user_id") % 16).cast("double").alias("f_user"))
    return map_cic_labels(df)


FLOW_FEATURES = ("f_value", "f_hour", "f_k", "f_user")


def raw_flows(spark: SparkSession, sf: str, keep_id: bool = False) -> DataFrame:
    """Events as raw text columns with missing, infinite and unparsable values."""
    e = read(spark, sf, "events")
    i = F.col("event_id")
    value = (F.when(i % 13 == 0, "10.0.0.1").when(i % 11 == 0, "inf").when(i % 7 == 0, None)
             .otherwise(F.col("value").cast("string")))
    hour = F.when(i % 17 == 0, "nan").otherwise(hour_of("ts").cast("string"))
    cols = [case(EVENT_LABELS, "event_type", F.col("event_type")).alias("label"), value.alias("flow_value"),
            hour.alias("flow_hour"), flow_k().alias("flow_k"),
            F.concat(F.lit("10.0."), (F.col("user_id") % 16).cast("string"), F.lit(".1")).alias("src_ip")]
    return e.select(*([i] if keep_id else []), *cols)


def split_of(dataset: str, key: str) -> Column:
    u = uniform(SEED, "part", F.lit(dataset), key)
    return F.when(u < 0.6, "train").when(u < 0.8, "val").otherwise("test")


def labelled_rows(spark: SparkSession, sf: str, orders: bool = False) -> DataFrame:
    def part(dataset: str, df: DataFrame, key: str, cls: Column) -> DataFrame:
        name = F.lit(dataset)
        return df.select(
            name.alias("dataset"), F.col(key).alias("row_id"), cls.alias("label_multiclass"),
            uniform(SEED, "sig", name, key).alias("u1"), uniform(SEED, "noise", name, key).alias("u2"),
            split_of(dataset, key).alias("split"))

    mapped = flows(spark, sf).select("row_id", "label_multiclass")
    out = part("events", mapped, "row_id", F.col("label_multiclass"))
    if orders:
        o = read_spread(spark, sf, "orders")
        out = out.unionByName(part("orders", o, "o_orderkey",
                                   case(ORDER_CLASSES, "o_orderstatus", F.lit("Unknown"))))
    return out.withColumn("y", F.when(F.col("label_multiclass") == "BENIGN", 0).otherwise(1))


def _run_structs(runs) -> Column:
    return F.expr("explode(array(" + ", ".join(
        f"named_struct('no', {r['no']}, 'model_name', '{r['model']}', 'epsilon', {double(r['eps'])}, "
        f"'q', {double(r['q'])}, 'speed', {double(r['speed'])}, 'run_id', '{r['model']}/{r['no']}')"
        for r in runs) + "))")


def run_id() -> Column:
    return F.concat_ws("/", "dataset", "r.run_id").alias("run_id")


def _fraction(k: Column) -> Column:
    return F.col("u2") * k - F.floor(F.col("u2") * k)


def _probability() -> Column:
    """Of label 1, by run ``r``."""
    signal = F.when(F.col("y") == 1, F.lit(0.5) + F.lit(0.5) * F.col("u1")).otherwise(
        F.lit(0.5) * F.col("u1"))
    return F.col("r.q") * signal + (F.lit(1.0) - F.col("r.q")) * _fraction(F.lit(101) + F.lit(7) * F.col("r.no"))


def _prediction_columns() -> list[Column]:
    return [run_id(), F.col("dataset"), F.lit("binary").alias("label_type"), F.col("r.model_name"), F.col("r.epsilon"), F.col("row_id"),
            F.col("split"), F.col("y").alias("y_true"), F.when(F.col("p") >= 0.5, 1).otherwise(0).alias("y_pred"),
            F.array(F.lit(1.0) - F.col("p"), F.col("p")).alias("probs")]


def predictions(spark: SparkSession, sf: str, splits=("val", "test"), orders: bool = False,
                chosen: DataFrame | None = None) -> DataFrame:
    """Binary predictions of every run: run columns, row_id, split, y_true, y_pred, probs.

    ``chosen`` restricts scoring to the (dataset, row_id, split) rows of a sample; its other columns come last.
    """
    rows = labelled_rows(spark, sf, orders).where(F.col("split").isin(*splits))
    key, more = ["dataset", "row_id", "split"], []
    if chosen is not None:
        rows, more = rows.join(chosen, key), [c for c in chosen.columns if c not in key]
    return rows.withColumn("r", _run_structs(RUNS)).withColumn("p", _probability()).select(*_prediction_columns(), *more)


def prediction_lists(spark: SparkSession, sf: str, splits=("val", "test"), orders: bool = False) -> DataFrame:
    """The same predictions with one row per record: dataset, row_id, split, y and the probabilities ``p`` of all runs in their order."""
    rows = labelled_rows(spark, sf, orders).where(F.col("split").isin(*splits))
    signal = F.when(F.col("y") == 1, F.lit(0.5) + F.lit(0.5) * F.col("u1")).otherwise(F.lit(0.5) * F.col("u1"))
    one = lambda r: F.lit(r["q"]) * signal + (F.lit(1.0) - F.lit(r["q"])) * _fraction(F.lit(101) + F.lit(7) * F.lit(r["no"]))
    return rows.select("dataset", "row_id", "split", "y", F.array(*[one(r) for r in RUNS]).alias("p"))


def listed_predictions(lists: DataFrame) -> DataFrame:
    """One row per run and record of :func:`prediction_lists`; further columns come last."""
    more = [c for c in lists.columns if c not in ("dataset", "row_id", "split", "y", "p")]
    return lists.withColumn("r", _run_structs(RUNS)).withColumn("p", F.get("p", F.col("r.no"))).select(*_prediction_columns(), *more)


def multi_predictions(spark: SparkSession, sf: str, splits=("val", "test")) -> DataFrame:
    """Five-class predictions of every run."""
    rows = labelled_rows(spark, sf).where(F.col("split").isin(*splits))
    code = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("label_multiclass")) - 1
    q, no = F.col("r.q"), F.col("r.no")
    raw = F.array(*[
        q * F.when(F.col("code") == c, 1.0).otherwise(0.0)
        + (F.lit(1.0) - q) * _fraction(F.lit(101) + F.lit(7) * no + F.lit(31 * c)) for c in range(5)])
    total = F.aggregate("raw", F.lit(0.0), lambda a, v: a + v)
    probs = F.transform("raw", lambda v: v / F.col("total"))
    return (
        rows.withColumn("code", code.cast("int")).withColumn("r", _run_structs(RUNS))
        .withColumn("raw", raw).withColumn("total", total).withColumn("probs", probs)
        .select(run_id(), "dataset", F.lit("multiclass").alias("label_type"), "r.model_name", "r.epsilon",
                "row_id", "split", F.col("code").alias("y_true"),
                (F.array_position("probs", F.array_max("probs")) - 1).cast("int").alias("y_pred"), "probs")
    )


def run_table(spark: SparkSession, sf: str, orders: bool = False) -> DataFrame:
    """One row per run; the training time is proportional to the training rows."""
    n = (labelled_rows(spark, sf, orders).where("split = 'train'")
         .groupBy("dataset").agg(F.count(F.lit(1)).alias("n_train")))
    sgd = F.col("r.model_name") == "dp_sgd"
    return n.withColumn("r", _run_structs(RUNS)).select(
        run_id(), "dataset", F.lit("binary").alias("label_type"), "r.model_name", "r.epsilon",
        F.when(sgd, F.lit(1e-5)).alias("delta"),
        F.when(sgd, F.col("r.epsilon") * F.lit(0.97)).alias("actual_epsilon"),
        (F.col("n_train") * F.col("r.speed") / F.lit(1000.0)).alias("train_time_s"))


SQL_RUN_META = """run_meta AS (SELECT dataset || '/' || run_id AS run_id, dataset, 'binary' AS label_type, model_name, epsilon,
  CASE WHEN model_name = 'dp_sgd' THEN 1e-5 END AS delta,
  CASE WHEN model_name = 'dp_sgd' THEN epsilon * 0.97e0 END AS actual_epsilon,
  n_train * speed / 1000e0 AS train_time_s
  FROM (SELECT dataset, count(*) AS n_train FROM rows WHERE split = 'train' GROUP BY dataset) n CROSS JOIN runs)"""

UNSW = UNSW_LABELS
