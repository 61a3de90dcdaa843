"""Result store, reports and plan shapes."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from sentinel.plans import reports
from sentinel.schema import EPSILON_GRID, RESULT_SCHEMA
from sentinel.sources import commits, ledger, tables
from workload import inputs as I
from workload import metric_queries, report_queries, sample_queries


def runs(spark, rows):
    """rows: (model, epsilon, f1)."""
    data = [(f"{m}/{e}", "d", "binary", m, e, "test", f1, f1, f1, 0.1, 0.9, f1, f1, 10.0) for m, e, f1 in rows]
    return spark.createDataFrame(data, "run_id string, dataset string, label_type string, model_name string, "
                                 "epsilon double, split string, f1_macro double, roc_auc double, mcc double, "
                                 "false_positive_rate double, detection_rate double, precision_macro double, "
                                 "recall_macro double, train_time_s double")


def test_save_is_an_upsert(spark, tmp_path):
    root = f"{tmp_path}/r"
    assert ledger.load(spark, root, RESULT_SCHEMA).count() == 0
    first = runs(spark, [("logistic_regression", None, 0.9), ("dp_sgd", 1.0, 0.5)])
    assert ledger.save(first, root, RESULT_SCHEMA) == 1
    assert ledger.save(first, root, RESULT_SCHEMA) == 2
    assert ledger.load(spark, root, RESULT_SCHEMA).count() == 2
    ledger.save(runs(spark, [("dp_sgd", 1.0, 0.7), ("dp_sgd", 2.0, 0.8), ("logistic_regression", None, 0.91)]),
                root, RESULT_SCHEMA)
    got = {(r["model_name"], r["epsilon"]): r["f1_macro"] for r in ledger.load(spark, root, RESULT_SCHEMA).collect()}
    assert got == {("logistic_regression", None): 0.91, ("dp_sgd", 1.0): 0.7, ("dp_sgd", 2.0): 0.8}


def test_incomplete_version_is_ignored(spark, tmp_path):
    root = f"{tmp_path}/r"
    ledger.save(runs(spark, [("xgboost", None, 0.9)]), root, RESULT_SCHEMA)
    (tmp_path / "r" / "v=2").mkdir()
    assert ledger.load(spark, root, RESULT_SCHEMA).count() == 1
    assert ledger.save(runs(spark, [("xgboost", None, 0.8)]), root, RESULT_SCHEMA) == 3


def test_parameters_round_trip(spark, tmp_path):
    root = f"{tmp_path}/m"
    with pytest.raises(FileNotFoundError):
        ledger.load_parameters(spark, root, "d", "binary", "dp_sgd", 1.0)
    df = spark.createDataFrame([("d", "binary", "dp_sgd", 1.0, ["a"], [0.5]), ("d", "binary", "scaler", None, ["a"], [2.0])],
                               "dataset string, label_type string, model_name string, epsilon double, "
                               "names array<string>, values array<double>")
    ledger.save(df, root, ledger.PARAMETER_SCHEMA, ledger.PARAMETER_KEY)
    assert ledger.load_parameters(spark, root, "d", "binary", "dp_sgd", 1.0) == [0.5]
    assert ledger.load_parameters(spark, root, "d", "binary", "scaler") == [2.0]
    with pytest.raises(ValueError):
        ledger.load_parameters(spark, root, "d", "binary", "dp_sgd")
    with pytest.raises(FileNotFoundError):
        ledger.load_parameters(spark, root, "d", "binary", "dp_sgd", 2.0)


def test_pending_treats_null_epsilon_as_a_value(spark):
    a = runs(spark, [("xgboost", None, 0.9), ("dp_sgd", 1.0, 0.5), ("dp_sgd", 2.0, 0.5)])
    done = spark.createDataFrame([("xgboost", None), ("dp_sgd", 2.0)], "target_model string, epsilon double")
    left = ledger.pending(a, done, [("model_name", "target_model"), ("epsilon", "epsilon")]).collect()
    assert [(r["model_name"], r["epsilon"]) for r in left] == [("dp_sgd", 1.0)]


def test_status(spark):
    st = {r["model_name"]: r for r in ledger.pipeline_status(
        runs(spark, [("xgboost", None, 0.9), ("dp_sgd", 1.0, 0.5)]), EPSILON_GRID).collect()}
    assert st["xgboost"]["complete"] and st["dp_sgd"]["n_trained"] == 1
    assert st["dp_random_forest"]["n_expected"] == 13 and not st["random_forest"]["complete"]


SWEEP = [("logistic_regression", None, 0.8), ("xgboost", None, 0.9),
         *[("dp_sgd", e, f) for e, f in [(0.1, 0.4), (0.5, 0.7), (1.0, 0.82), (2.0, 0.87), (5.0, 0.871), (10.0, 0.872)]],
         *[("dp_logistic_regression", e, f) for e, f in [(0.1, 0.45), (1.0, 0.82), (10.0, 0.83)]]]


def test_findings(spark):
    res = runs(spark, SWEEP).withColumn("actual_epsilon", F.col("epsilon") * 0.9)
    assert reports.min_viable_epsilon(res).first().asDict() == {
        "dataset": "d", "label_type": "binary", "min_eps_5pct": 2.0, "min_eps_10pct": 1.0}
    t = {r["model_name"]: r for r in reports.sharpest_transition(res).collect()}
    assert (t["dp_sgd"]["from_epsilon"], t["dp_sgd"]["to_epsilon"], t["dp_sgd"]["gain"]) == (0.1, 0.5, 0.3)
    n = {r["model_name"]: r for r in reports.noise_floor(res).collect()}
    assert n["dp_sgd"]["band"] == "wide" and not n["dp_sgd"]["plateau"]
    cost = reports.privacy_cost(res).first()
    assert cost["cost_pct"] == pytest.approx(3.1111) and cost["verdict"] == "low"
    best = reports.best_overall(res).first()
    assert best["best_model"] == "xgboost" and best["gap"] is None
    h = {r["epsilon"]: r["winner"] for r in reports.head_to_head(res).collect()}
    assert h == {0.1: "DP-LR", 1.0: "Tie", 10.0: "DP-SGD"}
    reg = reports.head_to_head_regimes(res).first()
    assert (reg["sgd_wins"], reg["lr_wins"], reg["ties"], reg["overall"]) == (1, 1, 1, "tied")
    trade = reports.loss_bands(reports.tradeoff_table(res))
    bands = {(r["model"], r["epsilon"]): r["band"] for r in trade.collect()}
    assert bands[("DP-SGD", 0.1)] == "red" and bands[("DP-LR", 1.0)] == "green" and bands[("DP-SGD", 0.5)] == "yellow"
    used = {r["target_epsilon"]: r["used_pct"] for r in reports.budget_utilisation(res).collect()}
    assert used[1.0] == 90.0
    table = reports.comparison_table(res, ["f1_macro"], with_loss=True).collect()
    assert [r["epsilon"] for r in table[:3]] == [None, None, 0.1] and table[0]["f1_loss_pct"] is None


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("build", [
    metric_queries.metric_suite, metric_queries.roc_auc_one_vs_rest, report_queries.comparison_table,
    report_queries.overview,    report_queries.upsert_latest, sample_queries.three_way_split, sample_queries.exact_quantile])
def test_plans_have_no_python_and_no_cross_join(spark, build):
    text = plan(build(spark, "/root/testdata/sf0.001"))
    for word in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in text


def test_counts_are_combined_before_the_shuffle_and_scans_are_pruned(spark):
    text = plan(metric_queries.accuracy(spark, "/root/testdata/sf0.001"))
    assert "partial_count" in text
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in text


def test_split_does_not_shuffle_its_rows(spark):
    rows = I.read(spark, "/root/testdata/sf0.001", "orders").select("o_orderkey", "o_orderstatus")
    text = plan(sample_queries.sample.add_split(rows, "o_orderkey", stratum="o_orderstatus"))
    assert "Exchange hashpartitioning" not in text and "Window" not in text


def test_savers_at_the_same_time_lose_no_row(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    root = f"{tmp_path}/r"
    parts = [runs(spark, [("dp_sgd", float(i), i / 10), ("dp_sgd", float(10 + i), i / 10), ("shared", None, i / 10)]) for i in range(1, 6)]
    with ThreadPoolExecutor(5) as pool:
        versions = list(pool.map(lambda p: ledger.save(p, root, RESULT_SCHEMA), parts))
    got = ledger.load(spark, root, RESULT_SCHEMA).collect()
    assert sorted(r["epsilon"] for r in got if r["epsilon"]) == [1, 2, 3, 4, 5, 11, 12, 13, 14, 15] and len(got) == 11
    last = [r for r in got if r["model_name"] == "shared"]
    assert len(last) == 1 and last[0]["version"] == max(versions)
    folders = [p.name for p in (tmp_path / "r").iterdir() if p.name.startswith("v=")]
    assert len(folders) == 5 and commits.CommitLog(spark, root).numbers() == [1, 2, 3, 4, 5]


def test_a_commit_is_made_once(spark, tmp_path):
    log = commits.CommitLog(spark, f"{tmp_path}/log")
    assert log.last() == (0, None) and log.append(0, {"folder": "a"}) and not log.append(0, {"folder": "b"})
    assert log.last() == (1, {"folder": "a"}) and log.append(1, {"folder": "c"}) and log.last()[1] == {"folder": "c"}
    with pytest.raises(FileExistsError):
        open(f"{tmp_path}/log/_commits/000000000001.json", "x")


def test_publish_switches_last_and_keeps_the_old_table_on_a_crash(spark, tmp_path):
    path = f"{tmp_path}/t"
    build = lambda value: lambda: tables.publish(spark.range(3).withColumn("v", F.lit(value)), path, ["v"], value)
    assert tables.build_once(spark, path, build("one"), of="one") and not tables.build_once(spark, path, build("one"), of="one")

    def crash():
        bad = F.udf(lambda i: 1 // (i - 2), "long")
        tables.publish(spark.range(3).select(bad("id").alias("v")), path, of="two")

    with pytest.raises(Exception):
        tables.build_once(spark, path, crash, of="two")
    assert {r["v"] for r in tables.read_table(spark, path).collect()} == {"one"}
    assert tables.build_once(spark, path, build("two"), of="two") and tables.build_once(spark, path, build("two"), of="two", force=True)
    assert tables.read_table(spark, path, ["v"]).distinct().collect()[0]["v"] == "two"
    assert commits.CommitLog(spark, path).vacuum() == 2 and tables.read_table(spark, path).count() == 3
    assert not tables.is_complete(spark, f"{tmp_path}/none")
