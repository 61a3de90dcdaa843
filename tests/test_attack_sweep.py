"""The attack sweep reads predictions where it needs them: none are shuffled or stored but those that fit an attacker."""

from pyspark.sql import functions as F

from sentinel.operators import attack
from sentinel.plans import mia


def _tables(spark, n=400):
    rows = spark.range(n).select(F.lit("d").alias("dataset"), F.col("id").alias("row_id"), F.when(F.col("id") % 5 < 3, "train").otherwise("test").alias("split"))
    p = (F.col("row_id") * 37 % 101) / 101.0
    preds = rows.withColumn("run_id", F.explode(F.array(*[F.lit(f"r{i}") for i in range(3)]))).withColumn("y_true", (F.col("row_id") % 2).cast("int")).withColumn(
        "y_pred", F.when(p > 0.5, 1).otherwise(0)).withColumn("probs", F.array(1 - p, p))
    return rows, preds


def _joined(preds, rows, fit_rows):
    """The same metrics from the join of the predictions with the sample."""
    met = mia.sampled_features(preds, attack.attack_sample(rows, "row_id", ["dataset"], fit_rows))
    metrics = attack.attack_metrics(attack.attack_scores(met, ["run_id"], "row_id"), ["run_id"])
    return metrics.join(mia.sample_sizes(met), ["run_id"])


def _same(found, wanted):
    rows = lambda df: sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)
    assert sorted(found.columns) == sorted(wanted.columns) and rows(found) == rows(wanted)


def test_same_as_the_join_with_the_sample(spark):
    rows, preds = _tables(spark)
    _same(mia.attack_runs(preds, rows, 60), _joined(preds, rows, 60))


def test_records_listed_twice_or_not_at_all(spark):
    """As in the join: a record counts as often as it is listed; one that is not listed, or has no key, does not count."""
    rows, preds = _tables(spark)
    listed = rows.where("row_id % 7 <> 0").unionByName(rows.where("row_id % 11 = 1")).unionByName(rows.limit(1).withColumn("row_id", F.lit(None).cast("bigint")))
    more = preds.unionByName(preds.where("row_id % 13 = 2")).unionByName(preds.limit(3).withColumn("row_id", F.lit(None).cast("bigint")))
    _same(mia.attack_runs(more, listed, 60), _joined(more, listed, 60))


def test_conditions_mark_the_sample(spark):
    rows, _ = _tables(spark)
    chosen = attack.sample_conditions(rows, "row_id", ["dataset"], 60)
    wanted = {(r["row_id"], r["part"]) for r in attack.attack_sample(rows, "row_id", ["dataset"], 60).collect()}
    parts = {name: {r["row_id"] for r in rows.where(of).collect()} for name, of in chosen.items()}
    assert parts["any"] == {k for k, _ in wanted} and all(parts[p] == {k for k, q in wanted if q == p} for p in ("test", "train"))


def test_only_fitting_rows_are_stored(spark, monkeypatch):
    rows, preds = _tables(spark)
    stored = []
    real = mia.cut_lineage
    monkeypatch.setattr(mia, "cut_lineage", lambda df: stored.append(df.columns) or stored.append(df.count()) or real(df))
    mia.attack_runs(preds, rows, 20).collect()
    assert all(n <= 2 * 20 * 3 for n in stored[1::2]) and any("attack_features" in c for c in stored[::2])
