"""Bucketed tables: joins without a shuffle, versions, and sessions that open what others have written."""

import re

import pytest
from pyspark.sql import functions as F

from sentinel.operators import attack
from sentinel.plans import mia
from sentinel.sources import buckets


def shuffles(df):
    return len(re.findall(r"(?m)^[\s:*+\-(0-9)]*Exchange ", df._jdf.queryExecution().executedPlan().toString()))


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def rows_of(spark, n=4000):
    return spark.range(n).select(F.lit("d").alias("dataset"), F.col("id").alias("row_id"),
                                 F.when(F.col("id") % 3 == 0, "test").otherwise("train").alias("split"))


def test_predictions_meet_the_sample_without_a_shuffle(spark, tmp_path, no_broadcast):
    rows = rows_of(spark)
    preds = rows.crossJoin(spark.range(3).select(F.concat(F.lit("run "), "id").alias("run_id"))).withColumn("y_true", F.lit(1)).withColumn(
        "y_pred", (F.col("row_id") % 2).cast("int")).withColumn("probs", F.array(F.lit(0.25), F.lit(0.75)))
    stored = buckets.write_bucketed(preds, f"{tmp_path}/p", mia.ROW, 8)
    listed = buckets.write_bucketed(rows, f"{tmp_path}/r", mia.ROW, 8)
    sampled = mia.sampled_features(stored, attack.attack_sample(listed, "row_id", ["dataset"], 100))
    plain = mia.sampled_features(preds, attack.attack_sample(rows, "row_id", ["dataset"], 100))
    assert shuffles(sampled) == 0 < shuffles(plain)
    as_set = lambda df: {(r["run_id"], r["row_id"], r["part"], r["loss"]) for r in df.collect()}
    assert as_set(sampled) == as_set(plain) and sampled.count() == plain.count() > 0


def test_one_file_per_bucket_and_all_rows(spark, tmp_path):
    out = buckets.write_bucketed(rows_of(spark), f"{tmp_path}/t", ["row_id"], 5)
    assert out.count() == 4000 and len(out.inputFiles()) == 5
    assert out.schema.fieldNames() == ["dataset", "row_id", "split"]


def test_versions_and_sessions(spark, tmp_path, no_broadcast):
    path = f"{tmp_path}/it's"
    old = buckets.write_bucketed(rows_of(spark, 10), path, ["row_id"], 4)
    buckets.write_bucketed(rows_of(spark, 20), path, ["row_id"], 4)
    assert old.count() == 10 and buckets.read_bucketed(spark, path).count() == 20
    for t in spark.catalog.listTables():
        if t.name.startswith("bucketed_"):
            spark.sql(f"DROP TABLE {t.name}")  # as in a session that has never seen them
    again = buckets.read_bucketed(spark, path)
    assert again.count() == 20 and shuffles(again.join(again.withColumnRenamed("split", "s"), "row_id")) == 0
    buckets.drop_bucketed(spark, path)
    with pytest.raises(FileNotFoundError):
        buckets.read_bucketed(spark, path)


def test_odd_tables(spark, tmp_path):
    nulls = spark.createDataFrame([(None, "a b"), (None, None), (1, "x"), (1, "x")], "`k y` long, `v.1` string")
    out = buckets.write_bucketed(nulls, f"{tmp_path}/n", ["k y"], 3)
    assert sorted(map(str, out.collect())) == sorted(map(str, nulls.collect()))
    assert buckets.write_bucketed(nulls.where("false"), f"{tmp_path}/e", ["k y"]).count() == 0
