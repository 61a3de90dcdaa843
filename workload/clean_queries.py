"""Scans, cleaning, labels, imputation and ingest."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinel.functions.cols import normalize_columns, rnd
from sentinel.functions.storage import list_dir, shared_dir
from sentinel.operators import clean, labels, sketches
from sentinel.plans import preprocess
from sentinel.schema import DEFAULTS
from sentinel.sources import raw, tables
from sentinel.streaming import ingest
from workload import inputs as I
from workload.registry import ctes, query

CLEAN = ctes(I.SQL_RAW, I.SQL_CLEAN)
CLEAN_COLUMNS = "label_raw, label_multiclass, flow_value, flow_hour, flow_k, src_ip"


@query("SELECT event_id, user_id, value AS value_raw, event_type AS flow_type FROM events")
def normalize_names(spark: SparkSession, sf: str) -> DataFrame:
    e = I.read(spark, sf, "events")
    return normalize_columns(e.select(
        F.col("event_id").alias(" Event ID"), F.col("user_id").alias("User  Id "),
        F.col("value").alias("Value (Raw)"), F.col("event_type").alias("__Flow/Type")))


@query("""SELECT dataset_source, count(*) AS n_rows, count(value) AS n_value, count(price) AS n_price
FROM (SELECT 'events' AS dataset_source, value, NULL AS price FROM events
      UNION ALL SELECT 'orders', NULL, o_totalprice FROM orders) GROUP BY 1""")
def union_sources(spark: SparkSession, sf: str) -> DataFrame:
    a = clean.add_source(I.read(spark, sf, "events").select("value"), "events")
    b = clean.add_source(I.read(spark, sf, "orders").select(F.col("o_totalprice").alias("price")), "orders")
    return tables.union_sources(a, b).groupBy("dataset_source").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("n_value"), F.count("price").alias("n_price"))


@query(CLEAN + f"SELECT DISTINCT {CLEAN_COLUMNS} FROM cleaned")
def global_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = preprocess.clean_rows(I.raw_flows(spark, sf), "cic_ids2018")
    return clean.drop_duplicates(rows.drop("dataset_source", "label_binary"))


@query("""SELECT lang, source, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars
FROM (SELECT DISTINCT text, lang, source, n_chars FROM documents) GROUP BY 1, 2""")
def dedup_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = clean.drop_duplicates(I.read(spark, sf, "documents").drop("doc_id"))
    return docs.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"))


@query("""SELECT event_id, CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 THEN NULL ELSE value END AS value
FROM events""")
def inf_to_null(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    broken = F.when(i % 11 == 0, float("inf")).when(i % 13 == 0, float("nan")).otherwise(F.col("value"))
    return I.read(spark, sf, "events").select("event_id", clean.inf_to_null(broken).alias("value"))


@query(ctes(I.SQL_RAW) + f"""SELECT event_id, {I.sql_float('flow_value')} AS flow_value,
{I.sql_float('flow_hour')} AS flow_hour, {I.sql_float('flow_k')} AS flow_k, {I.sql_float('src_ip')} AS src_ip
FROM raw_flows""")
def coerce_float(spark: SparkSession, sf: str) -> DataFrame:
    df = I.raw_flows(spark, sf, keep_id=True).drop("label").withColumnRenamed("event_id", "split")
    return clean.coerce_features(df).withColumnRenamed("split", "event_id")


@query(ctes(I.SQL_FLOWS) + f"""SELECT row_id, label_raw, label_multiclass, {I.SQL_BINARY} AS label_binary
FROM flows""")
def taxonomy_map(spark: SparkSession, sf: str) -> DataFrame:
    return I.flows(spark, sf).select("row_id", "label_raw", "label_multiclass",
                                     F.col("label_binary").cast("int").alias("label_binary"))


_CAT = f"coalesce(trim({I.sql_case(I.EVENT_CATEGORIES, 'event_type', 'NULL')}), '')"


@query(f"""SELECT event_id, {_CAT} AS label_raw,
{I.sql_case(I.UNSW, f"lower({_CAT})", "'Unknown'")} AS label_multiclass,
CASE WHEN value > 50 THEN 1 ELSE 0 END AS label_binary FROM events""")
def taxonomy_map_nullable(spark: SparkSession, sf: str) -> DataFrame:
    e = I.read(spark, sf, "events").select(
        "event_id", I.case(I.EVENT_CATEGORIES, "event_type", F.lit(None)).alias("attack_cat"),
        F.when(F.col("value") > 50, "1").otherwise("0").alias("label"))
    return labels.map_unsw_labels(e).withColumn("label_binary", F.col("label_binary").cast("int"))


@query(ctes(I.SQL_FLOWS) + f"""SELECT label_multiclass, {I.SQL_BINARY} AS label_binary, count(*) AS n_rows
FROM flows GROUP BY 1, 2""")
def binary_label(spark: SparkSession, sf: str) -> DataFrame:
    return I.flows(spark, sf).groupBy("label_multiclass", F.col("label_binary").cast("int").alias(
        "label_binary")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("SELECT trim(o_orderpriority) AS label_raw, count(*) AS n_rows FROM orders GROUP BY 1")
def unmapped_audit(spark: SparkSession, sf: str) -> DataFrame:
    return labels.unmapped_labels(labels.map_cic_labels(
        I.read(spark, sf, "orders").select(F.col("o_orderpriority").alias("label"))))


_FRACTIONS = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {I.sql_round(f'avg(CASE WHEN {c} IS NULL THEN 1e0 ELSE 0e0 END)')} AS null_fraction "
    "FROM cleaned" for c in ("flow_value", "flow_hour", "flow_k", "src_ip"))


@query(CLEAN + _FRACTIONS)
def null_fractions(spark: SparkSession, sf: str) -> DataFrame:
    rows = preprocess.clean_rows(I.raw_flows(spark, sf), "cic_ids2018")
    return clean.null_fractions(rows).withColumn("null_fraction", rnd("null_fraction", 6))


@query(CLEAN + f"SELECT 'cic_ids2018' AS dataset, feature AS column_name, null_fraction "
       f"FROM ({_FRACTIONS}) WHERE null_fraction > 0.6")
def dropped_columns(spark: SparkSession, sf: str) -> DataFrame:
    rows = preprocess.clean_rows(I.raw_flows(spark, sf), "cic_ids2018")
    _, dropped = clean.drop_sparse_columns(rows)
    return clean.null_fractions(rows, dropped).select(
        F.lit("cic_ids2018").alias("dataset"), F.col("feature").alias("column_name"),
        rnd("null_fraction", 6).alias("null_fraction"))


_MEDIAN = "CAST((SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM {t}) AS FLOAT)"


def _filled(table: str) -> str:
    return ", ".join(f"coalesce({c}, {_MEDIAN.format(c=c, t=table)}) AS {c}"
                     for c in ("flow_value", "flow_hour", "flow_k"))


@query(CLEAN + f"SELECT label_raw, label_multiclass, {_filled('cleaned')} FROM cleaned")
def impute_median(spark: SparkSession, sf: str) -> DataFrame:
    rows = preprocess.clean_rows(I.raw_flows(spark, sf), "cic_ids2018").drop(
        "src_ip", "dataset_source", "label_binary")
    return clean.impute(rows)


@query(CLEAN + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {I.sql_round(f'avg(CAST({c} AS DOUBLE))', 4)} AS fill_value FROM cleaned"
    for c in ("flow_value", "flow_hour", "flow_k")))
def impute_mean(spark: SparkSession, sf: str) -> DataFrame:
    rows = preprocess.clean_rows(I.raw_flows(spark, sf), "cic_ids2018")
    return clean.numeric_fill_values(rows, ["flow_value", "flow_hour", "flow_k"], "mean").select(
        "feature", rnd("fill_value", 4).alias("fill_value"))


_GAPS = "gaps AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE lang END AS lang, " \
        "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE source END AS source FROM documents)"


def _mode(c: str) -> str:
    return f"(SELECT {c} FROM gaps WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@query(ctes(_GAPS) + f"SELECT doc_id, coalesce(lang, {_mode('lang')}) AS lang, "
       f"coalesce(source, {_mode('source')}) AS source FROM gaps")
def impute_mode(spark: SparkSession, sf: str) -> DataFrame:
    d = I.read(spark, sf, "documents")
    gaps = d.select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("lang"),
                    F.when(F.col("doc_id") % 7 != 0, F.col("source")).alias("source"))
    return clean.impute(gaps)


@query(ctes(I.SQL_FLOWS) + """SELECT row_id, f.label_multiclass, CAST(code AS INTEGER) AS code FROM flows f
JOIN (SELECT label_multiclass, dense_rank() OVER (ORDER BY label_multiclass) - 1 AS code
      FROM (SELECT DISTINCT label_multiclass FROM flows)) e USING (label_multiclass)""")
def encode_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.flows(spark, sf).select("row_id", "label_multiclass")
    return labels.encode(rows, labels.fit_encoder(rows))


def _write_raw_csv(spark: SparkSession, sf: str) -> str:
    """The raw flows as header CSV files under <shared folder>/<new>/cic_ids2018."""
    root = f"{shared_dir(spark).rstrip('/')}/raw-{uuid.uuid4().hex}"
    out = I.raw_flows(spark, sf).select(
        F.col("flow_value").alias(" Flow Value"), F.col("flow_hour").alias("Flow Hour "),
        F.col("flow_k").alias("Flow/K"), F.col("src_ip").alias("Src IP"), F.col("label").alias("Label"))
    out.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).csv(f"{root}/cic_ids2018")
    return root


@query(CLEAN + f"SELECT {CLEAN_COLUMNS} FROM cleaned")
def csv_ingest(spark: SparkSession, sf: str) -> DataFrame:
    rows = raw.read_raw(spark, _write_raw_csv(spark, sf), "cic_ids2018")
    return preprocess.clean_rows(rows, "cic_ids2018").drop("dataset_source", "label_binary")


@query(CLEAN + f"SELECT {CLEAN_COLUMNS} FROM cleaned")
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    root = _write_raw_csv(spark, sf)
    ingest.ingest_available(spark, root, "cic_ids2018", f"{root}/out", f"{root}/state")
    return ingest.read_ingested(spark, f"{root}/out").drop("dataset_source", "label_binary")


def _write_layouts(spark: SparkSession, sf: str) -> str:
    """The events as files of three layouts: plain; two more columns in front; swapped, with short and over-long rows."""
    root = f"{shared_dir(spark).rstrip('/')}/raw-{uuid.uuid4().hex}"
    e = I.read(spark, sf, "events")
    value, user, kind = F.format_string("%.4f", "value"), F.col("user_id").cast("string"), F.col("event_type")
    quoted = F.concat(F.lit('"'), kind, F.lit(',x"'))
    lines = {
        "Flow Value,User ID,Label": F.concat_ws(",", value, user, kind),
        "Flow ID, Src IP,Flow Value,User ID,Label": F.concat_ws(",", F.col("event_id").cast("string"), F.lit("10.0.0.1"), value, user, quoted),
        "User ID,Flow Value,Label": F.when(F.col("event_id") % 5 == 0, user).when(
            F.col("event_id") % 7 == 0, F.concat_ws(",", user, value, kind, F.lit("more"))).otherwise(F.concat_ws(",", user, value, kind)),
    }
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs.mkdirs(path(f"{root}/cic_ids2018"))
    for i, (header, line) in enumerate(lines.items()):
        part = e.where(F.col("event_id") % 3 == i).select(line.alias(header))
        part.write.option("header", True).option("sep", "\u0001").option("escapeQuotes", False).csv(f"{root}/layout{i}")
        for k, name in enumerate(n for n in list_dir(spark, f"{root}/layout{i}") if n.endswith(".csv")):
            fs.rename(path(f"{root}/layout{i}/{name}"), path(f"{root}/cic_ids2018/part{i}-{k}.csv"))
    return root


_LAYOUT_ROWS = """SELECT CASE WHEN event_id % 3 = 2 AND event_id % 5 = 0 THEN NULL ELSE round(value, 4) END AS flow_value,
  CAST(user_id AS DOUBLE) AS user_id, CASE WHEN event_id % 3 = 1 THEN event_id END AS flow_id,
  CASE WHEN event_id % 3 = 2 AND event_id % 5 = 0 THEN NULL WHEN event_id % 3 = 1 THEN event_type || ',x' ELSE event_type END AS label
FROM events WHERE NOT (event_id % 3 = 2 AND event_id % 5 <> 0 AND event_id % 7 = 0)"""


def _layout_columns(df: DataFrame) -> DataFrame:
    return df.select(F.round(F.col("flow_value").cast("double"), 4).alias("flow_value"), F.col("user_id").cast("double").alias("user_id"),
                     F.col("flow_id").cast("long").alias("flow_id"), "label")


@query(_LAYOUT_ROWS)
def csv_ingest_layouts(spark: SparkSession, sf: str) -> DataFrame:
    return _layout_columns(raw.read_raw(spark, _write_layouts(spark, sf), "cic_ids2018"))


@query(f"""SELECT coalesce(label, 'nan') AS label_raw, CAST(flow_value AS FLOAT) AS flow_value, CAST(user_id AS FLOAT) AS user_id,
CAST(flow_id AS FLOAT) AS flow_id FROM ({_LAYOUT_ROWS})""")
def stream_ingest_layouts(spark: SparkSession, sf: str) -> DataFrame:
    root = _write_layouts(spark, sf)
    ingest.ingest_available(spark, root, "cic_ids2018", f"{root}/out", f"{root}/state", files_per_batch=2)
    return ingest.read_ingested(spark, f"{root}/out").select("label_raw", "flow_value", "user_id", "flow_id")


@query("""SELECT count(*) FILTER (event_id % 3 = 2 AND event_id % 5 <> 0 AND event_id % 7 = 0) AS n_malformed, count(*) AS n_filled FROM events""")
def malformed_rows(spark: SparkSession, sf: str) -> DataFrame:
    counts = raw.count_malformed(spark, _write_layouts(spark, sf), "cic_ids2018")
    return counts.agg(F.sum("n_malformed").alias("n_malformed"), F.sum("n_filled").alias("n_filled"))


def _write_quoted(spark: SparkSession, sf: str) -> str:
    """Events as a file of plain records and a file whose notes hold doubled quotes, separators, line breaks and backslashes."""
    root = f"{shared_dir(spark).rstrip('/')}/raw-{uuid.uuid4().hex}"
    e, number = I.read(spark, sf, "events"), F.col("event_id")
    note = (F.when(number % 4 == 0, F.concat(F.lit('say "'), "event_type", F.lit('", ok'))).when(number % 4 == 1, F.concat("event_type", F.lit("\n,second line")))
            .when(number % 4 == 2, F.concat("event_type", F.lit("\\"))).otherwise(F.col("event_type")))
    for odd, name in ((0, "spanning"), (1, "plain")):
        part = e.where(number % 8 == 7 if odd else number % 8 != 7).select(
            F.col("event_id").cast("string").alias("Flow ID"), note.alias("Note"), F.col("event_type").alias("Label"))
        part.write.mode("append").option("header", True).option("escape", '"').option("ignoreTrailingWhiteSpace", False).csv(f"{root}/cic_ids2018")
    return root


_QUOTED = """SELECT event_id AS flow_id, CASE event_id % 4 WHEN 0 THEN 'say "' || event_type || '", ok' WHEN 1 THEN event_type || chr(10) || ',second line'
WHEN 2 THEN event_type || chr(92) ELSE event_type END AS note, event_type AS label FROM events"""


@query(_QUOTED)
def csv_ingest_quoted(spark: SparkSession, sf: str) -> DataFrame:
    """Doubled quotes, separators, line breaks and backslashes within fields, in files of which some can be split and some cannot."""
    rows = raw.read_raw(spark, _write_quoted(spark, sf), "cic_ids2018")
    return rows.select(F.col("flow_id").cast("long").alias("flow_id"), "note", "label")


@query(f"SELECT flow_id % 4 AS kind, count(*) AS n_rows, count(DISTINCT note) AS n_notes, coalesce(max(length(note)), 0) AS longest FROM ({_QUOTED}) GROUP BY 1")
def stream_ingest_quoted(spark: SparkSession, sf: str) -> DataFrame:
    root = _write_quoted(spark, sf)
    batches = ingest.stream_files(spark, root, "cic_ids2018", 3).writeStream.foreachBatch(
        lambda batch, number: raw.read_files(batch.sparkSession, sorted(r["path"] for r in batch.collect()), "cic_ids2018").write.mode(
            "overwrite").parquet(f"{root}/out/batch={number}"))
    batches.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{root}/out").groupBy((F.col("flow_id").cast("long") % 4).alias("kind"))
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("note").alias("n_notes"), F.coalesce(F.max(F.length("note")), F.lit(0)).cast("long").alias("longest"))


@query(CLEAN + f"SELECT DISTINCT {CLEAN_COLUMNS} FROM cleaned")
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Files that arrive one by one: the table holds every distinct row once, wherever its copies were."""
    root = _write_raw_csv(spark, sf)
    ingest.ingest_distinct(spark, root, "cic_ids2018", f"{root}/out", f"{root}/state", files_per_batch=2)
    return ingest.read_ingested(spark, f"{root}/out").drop("dataset_source", "label_binary")


_LAYOUT_DISTINCT = f"""SELECT DISTINCT coalesce(label, 'nan') AS label_raw, CAST(flow_value AS FLOAT) AS flow_value, CAST(user_id AS FLOAT) AS user_id,
CAST(flow_id AS FLOAT) AS flow_id FROM ({_LAYOUT_ROWS})"""


@query(_LAYOUT_DISTINCT)
def stream_dedup_layouts(spark: SparkSession, sf: str) -> DataFrame:
    """As stream_dedup, with files of three layouts: a column that a file lacks is equal to one that is empty."""
    root = _write_layouts(spark, sf)
    ingest.ingest_distinct(spark, root, "cic_ids2018", f"{root}/out", f"{root}/state", files_per_batch=1)
    rows = ingest.read_ingested(spark, f"{root}/out")
    extra = [c for c in rows.columns if c == "src_ip"]
    return rows.drop(*extra).select("label_raw", "flow_value", "user_id", "flow_id").distinct()


_SKETCH_PROBS = (0.01, 0.25, 0.5, 0.75, 0.99)
_WITHIN = 0.02


@query(ctes(I.SQL_FLOWS) + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, CAST(p AS DOUBLE) AS prob, count({f}) AS n, true AS within FROM flows CROSS JOIN (VALUES {', '.join(f'({p}e0)' for p in _SKETCH_PROBS)}) v(p) GROUP BY p"
    for f in I.FLOW_FEATURES))
def sketch_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Quantiles from stored sketches of four batches, and whether their ranks in the whole table are within 2 % of the wanted ones."""
    root = f"{shared_dir(spark).rstrip('/')}/sketches-{uuid.uuid4().hex}"
    flows = I.flows(spark, sf)
    for batch in range(4):
        sketches.add_batch(flows.where(F.col("row_id") % 4 == batch), I.FLOW_FEATURES, root, batch)
    found = sketches.quantiles(sketches.merged(spark, root), _SKETCH_PROBS)
    return sketches.rank_error(flows, I.FLOW_FEATURES, found).select("feature", "prob", "n", (F.col("rank_error") <= _WITHIN).alias("within"))


SUBSET_ROWS = 500
_QUOTA = f""", u AS (SELECT DISTINCT {CLEAN_COLUMNS} FROM cleaned),
c AS (SELECT label_multiclass, count(*) AS n FROM u GROUP BY 1),
q AS (SELECT label_multiclass, floor(n / CAST(sum(n) OVER () AS DOUBLE) * {SUBSET_ROWS}e0) AS q FROM c),
t AS (SELECT *, floor(q * 0.2e0 + 0.5e0) AS test FROM q),
v AS (SELECT *, floor((q - test) * 0.25e0 + 0.5e0) AS val FROM t)"""


def _staged(spark: SparkSession, sf: str) -> str:
    """Raw files, processed table and subset of one data set in a new folder."""
    root = _write_raw_csv(spark, sf)
    preprocess.run_preprocessing(spark, root, root, "cic_ids2018")
    preprocess.run_sampling(spark, root, "cic_ids2018", replace(DEFAULTS, subset_size=SUBSET_ROWS, seed=I.SEED))
    return root


@query(CLEAN + _QUOTA + """SELECT label_multiclass, split, CAST(n_rows AS BIGINT) AS n_rows FROM (
SELECT label_multiclass, 'test' AS split, test AS n_rows FROM v UNION ALL SELECT label_multiclass, 'val', val FROM v
UNION ALL SELECT label_multiclass, 'train', q - test - val FROM v) WHERE n_rows > 0""")
def processed_to_subset(spark: SparkSession, sf: str) -> DataFrame:
    """Quotas hold exactly although filled gaps make processed rows equal."""
    subset = tables.read_table(spark, f"{_staged(spark, sf)}/subsets/cic_ids2018")
    return subset.groupBy("label_multiclass", "split").agg(F.countDistinct("row_id").alias("n_rows"))


@query(CLEAN + _QUOTA + """SELECT 'raw' AS stage, true AS complete, count(*) AS n_rows FROM events
UNION ALL SELECT 'processed', true, count(*) FROM u UNION ALL SELECT 'subset', true, CAST(sum(q) AS BIGINT) FROM q
UNION ALL SELECT 'results', false, 0""")
def stage_status(spark: SparkSession, sf: str) -> DataFrame:
    root = _staged(spark, sf)
    return tables.stage_status(spark, root, root, "cic_ids2018")


@query(CLEAN + f""", u AS (SELECT DISTINCT {CLEAN_COLUMNS} FROM cleaned)
SELECT label_raw, label_multiclass, {_filled('u')}, CAST({I.SQL_BINARY} AS INTEGER) AS label_binary,
'cic_ids2018' AS dataset_source FROM u""")
def processed_table(spark: SparkSession, sf: str) -> DataFrame:
    df, _ = preprocess.clean_table(I.raw_flows(spark, sf), "cic_ids2018")
    return df.drop("row_id").withColumn("label_binary", F.col("label_binary").cast("int"))
