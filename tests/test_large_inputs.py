"""Steps that broke on larger tables, on small ones that show the same fault."""

import pytest
from pyspark.sql import functions as F

from sentinel.operators import accountant
from sentinel.plans import mia
from workload import inputs as I


def test_predictions_are_not_broadcast_to_a_large_sample(spark, monkeypatch):
    """Predictions that are made by an explode look small to the planner."""
    rows = spark.range(2000).select(F.lit("d").alias("dataset"), F.col("id").alias("row_id"), F.lit("train").alias("split"))
    preds = rows.withColumn("run_id", F.explode(F.array(*[F.lit(f"r{i}") for i in range(30)]))).withColumn("y_true", F.lit(1)).withColumn(
        "y_pred", F.lit(1)).withColumn("probs", F.array(F.lit(0.25), F.lit(0.75)))
    sample = rows.withColumn("member", F.lit(1)).withColumn("part", F.lit("train"))
    monkeypatch.setattr(mia, "small_table", lambda df: df)
    met = mia.sampled_features(preds, sample)
    assert "BroadcastExchange" not in met._jdf.queryExecution().executedPlan().toString()
    assert met.count() == 60_000


def test_small_sample_is_broadcast(spark):
    rows = spark.range(20).select(F.lit("d").alias("dataset"), F.col("id").alias("row_id"), F.lit("train").alias("split"))
    preds = rows.withColumn("y_true", F.lit(1)).withColumn("y_pred", F.lit(1)).withColumn("probs", F.array(F.lit(0.25), F.lit(0.75)))
    met = mia.sampled_features(preds, rows.where("row_id < 5").withColumn("member", F.lit(1)).withColumn("part", F.lit("train")))
    assert "BroadcastHashJoin" in met._jdf.queryExecution().executedPlan().toString() and met.count() == 5


@pytest.mark.parametrize("partitions", [1, 7])
def test_whole_and_real_orders_are_compared_on_the_same_sums(spark, partitions):
    steps = spark.range(4000).select((F.col("id") % 40).alias("k"), (F.lit(0.001) * (1 + F.col("id") % 11)).alias("rate"),
                                     (F.lit(0.8) + F.col("id") % 9 / 10).alias("sigma"), (F.col("id") % 977 + 1).alias("steps")).repartition(partitions)
    both = accountant.spent_epsilon(steps, ["k"], 1e-5, real_orders=accountant.REAL_ORDERS).collect()
    alone = {r["k"]: r["epsilon"] for r in accountant.spent_epsilon(steps, ["k"], 1e-5).collect()}
    assert len(both) == 40 and all(r["epsilon"] <= r["whole_epsilon"] for r in both)
    assert [r["whole_epsilon"] for r in both] == pytest.approx([alone[r["k"]] for r in both])


def test_stored_lists_give_the_same_predictions(spark):
    """One stored row per record, not per record and run."""
    sf = "/root/testdata/sf0.001"
    lists = I.prediction_lists(spark, sf, ("val", "test"), True)
    assert lists.count() == I.labelled_rows(spark, sf, True).where("split <> 'train'").count()
    got, want = I.listed_predictions(lists), I.predictions(spark, sf, ("val", "test"), True)
    assert got.schema.names == want.schema.names and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
