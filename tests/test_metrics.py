"""Metrics on hand-built predictions with known values."""

import pytest
from pyspark.sql import functions as F

from sentinel.operators import metrics as M
from sentinel.operators.ranking import roc_auc

KEYS = ["run_id"]


def frame(spark, truth, pred, probs=None):
    rows = [("r", i, t, p) + ((probs[i],) if probs else ()) for i, (t, p) in enumerate(zip(truth, pred))]
    return spark.createDataFrame(
        rows, "run_id string, row_id int, y_true int, y_pred int" + (", probs array<double>" if probs else ""))


def suite(spark, truth, pred, probs=None, kind="binary"):
    return M.evaluate(frame(spark, truth, pred, probs), KEYS, kind).first()


@pytest.mark.parametrize("truth, pred, field, value", [
    ([0] * 10 + [1], [0] * 8 + [1, 1] + [1], "false_positive_rate", 0.2),
    ([1] * 10 + [0], [1] * 7 + [0] * 3 + [0], "detection_rate", 0.7),
    ([1, 1, 1, 1, 0, 0, 0, 0], [1, 1, 0, 0, 0, 0, 1, 1], "false_negative_rate", 0.5),
    ([0, 0, 0, 1, 1, 1], [0, 0, 0, 1, 1, 1], "false_positive_rate", 0.0),
    ([0, 0, 0, 1, 1, 1], [0, 0, 0, 1, 1, 1], "mcc", 1.0),
    ([0] * 5, [1] * 5, "false_positive_rate", 1.0),
    ([0, 1, 0, 1], [0, 0, 0, 0], "f1_macro", 1 / 3),
])
def test_known_values(spark, truth, pred, field, value):
    assert suite(spark, truth, pred)[field] == pytest.approx(value)


def test_detection_and_miss_rates_add_up(spark):
    r = suite(spark, [1, 1, 1, 1, 0, 0, 0, 0], [1, 1, 0, 1, 0, 0, 1, 1])
    assert r["detection_rate"] + r["false_negative_rate"] == pytest.approx(1.0)


def test_rates_are_null_with_one_label_only(spark):
    r = suite(spark, [1, 1], [1, 1])
    assert r["false_positive_rate"] is None and r["detection_rate"] is None
    assert r["accuracy"] == 1.0 and r["mcc"] == 0.0


def test_auc_perfect_missing_and_one_class(spark):
    probs = [[0.9, 0.1], [0.8, 0.2], [0.1, 0.9], [0.2, 0.8]]
    assert suite(spark, [0, 0, 1, 1], [0, 0, 1, 1], probs)["roc_auc"] == 1.0
    assert suite(spark, [0, 1, 0, 1], [0, 1, 0, 1])["roc_auc"] is None
    assert suite(spark, [1, 1, 1, 1], [1, 1, 1, 1], probs)["roc_auc"] is None


def test_unknown_label_type(spark):
    with pytest.raises(ValueError):
        M.evaluate(frame(spark, [0], [0]), KEYS, "ranking")


def test_multiclass_report_and_union_of_labels(spark):
    conf = M.confusion(frame(spark, [0, 0, 1, 1, 2, 2], [0, 1, 1, 0, 2, 3]), KEYS)
    rows = {r["row"]: r for r in M.classification_report(conf, KEYS).collect()}
    assert set(rows) == {"0", "1", "2", "3", "accuracy", "macro avg", "weighted avg"}
    assert rows["0"]["f1"] == pytest.approx(0.5) and rows["3"]["f1"] == 0.0
    assert rows["accuracy"]["f1"] == pytest.approx(0.5)
    assert rows["macro avg"]["f1"] == pytest.approx((0.5 + 0.5 + 2 / 3 + 0) / 4)
    matrix = M.confusion_matrix(conf, KEYS).first()
    assert matrix["labels"] == [0, 1, 2, 3]
    assert matrix["confusion_matrix"] == [[1, 1, 0, 0], [1, 1, 0, 0], [0, 0, 1, 1], [0, 0, 0, 0]]


def brute_auc(scores, hits):
    pairs = [(p, n) for p, hp in zip(scores, hits) if hp for n, hn in zip(scores, hits) if not hn]
    return sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in pairs) / len(pairs)


@pytest.mark.parametrize("scale", [1.0, 1e-9, 1e-320])
def test_auc_against_all_pairs(spark, scale):
    """Ties, scores in one narrow band, and scores at both ends of the range."""
    rows = [("a", ((i * 37) % 101) / 100 * scale, int((i * 7) % 5 < 2)) for i in range(200)]
    rows += [("b", 1.0 - ((i * 31) % 17) * 1e-16, int(i % 3 == 0)) for i in range(60)]
    rows += [("c", 0.5, int(i % 2)) for i in range(10)]
    df = spark.createDataFrame(rows, "run_id string, s double, y int")
    got = {r["run_id"]: r["roc_auc"] for r in roc_auc(df, KEYS, "s", F.col("y") == 1).collect()}
    for run in "abc":
        part = [r for r in rows if r[0] == run]
        assert got[run] == pytest.approx(brute_auc([r[1] for r in part], [r[2] for r in part]))


def test_auc_unchanged_by_monotone_map(spark):
    df = spark.range(500).select(
        F.lit("r").alias("run_id"), (F.pmod("id", F.lit(97)) / 100.0).alias("s"),
        (F.pmod("id", F.lit(11)) < 4).alias("y"))
    a = roc_auc(df, KEYS, "s", F.col("y")).first()["roc_auc"]
    b = roc_auc(df.withColumn("s", F.sqrt("s") / 2), KEYS, "s", F.col("y")).first()["roc_auc"]
    assert a == pytest.approx(b, abs=1e-12)


def test_utility_loss(spark):
    df = spark.createDataFrame([(0.9, 0.9), (0.8, 0.72), (0.8, 0.95), (0.0, 0.5), (0.8, None)], "b double, v double")
    loss, pct = M.utility_loss(F.col("b"), F.col("v"))
    got = df.select(loss.alias("l"), pct.alias("p")).collect()
    assert [tuple(r) for r in got] == [(0.0, 0.0), (0.08, 10.0), (-0.15, -18.75), (None, None), (None, None)]


def test_rows_without_probabilities_do_not_count_for_auc(spark):
    probs = [[0.9, 0.1], [0.8, 0.2], [0.1, 0.9], [0.2, 0.8], None, None]
    r = suite(spark, [0, 0, 1, 1, 0, 1], [0, 0, 1, 1, 1, 0], probs)
    assert r["roc_auc"] == 1.0 and r["accuracy"] == pytest.approx(4 / 6)


@pytest.mark.parametrize("kind", ["binary", "multiclass"])
def test_suite_scans_its_input_once(spark, tmp_path, monkeypatch, kind):
    rows = [("r", "test", i % 2, (i // 2) % 2, [1 - i / 40, i / 40]) for i in range(40)]
    path = f"{tmp_path}/preds"
    spark.createDataFrame(rows, "run_id string, split string, y_true int, y_pred int, probs array<double>").write.parquet(path)
    seen, cut = [], M.cut_lineage
    monkeypatch.setattr(M, "cut_lineage", lambda d: seen.append(d._jdf.queryExecution().executedPlan().toString()) or cut(d))
    df = M.evaluate(spark.read.parquet(path), ["run_id", "split"], kind)
    df.collect()
    assert len(seen) == 1 and seen[0].count("FileScan parquet") == 1
    assert "FileScan" not in df._jdf.queryExecution().executedPlan().toString()
