"""The model store, sweeps that resume, failed runs, and attacks that save their records."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentinel.plans import evaluate, mia, train
from sentinel.schema import ATTACK_SCHEMA, DEFAULTS, MODEL_ORDER
from sentinel.sources import ledger
from sentinel.sources.models import ModelStore

SMALL = replace(DEFAULTS, epsilons=(1.0, 50.0), n_trees=5, tree_depth=3, boosting_rounds=3, hidden_layers=(8,), epochs=2)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4))
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] > 0.5).astype(int)
    rows = [(i, ("train", "train", "train", "val", "test")[i % 5], *map(float, r), int(c > 0), "ABC"[c]) for i, (r, c) in enumerate(zip(x, y))]
    subset = spark.createDataFrame(rows, "row_id long, split string, f0 double, f1 double, f2 double, f3 double, label_binary int, label_multiclass string")
    return train.prepare(subset, label_type="multiclass")


def predictions(preds):
    return {(r["model_name"], r["epsilon"], r["row_id"]): (r["y_pred"], tuple(round(p, 9) for p in r["probs"])) for r in preds.collect()}


def test_six_families_round_trip(spark, data, tmp_path):
    store = ModelStore(spark, f"{tmp_path}/models")
    first, runs = train.run_models(data, "d", "multiclass", settings=SMALL, seed=1, store=store)
    again, later = train.run_models(data, "d", "multiclass", settings=SMALL, seed=2, store=store)
    assert predictions(first) == predictions(again) and len(predictions(first)) == 300 * 9
    a, b = ({(r["model_name"], r["epsilon"]): r for r in t.collect()} for t in (runs, later))
    assert len(a) == 9 and all(r["status"] == "trained" and r["train_time_s"] is not None for r in a.values())
    assert all(r["status"] == "loaded" and r["train_time_s"] is None and r["actual_epsilon"] == a[k]["actual_epsilon"] for k, r in b.items())
    listed = store.listing().collect()
    assert {(r["model_name"], r["epsilon"]) for r in listed} == set(a) and all(r["n_parameters"] > 0 and r["version"] == 1 for r in listed)
    size = {r["model_name"]: r["n_parameters"] for r in listed}
    assert size["dp_random_forest"] == 10 * 32 and size["dp_logistic_regression"] == 3 * 5 and size["dp_sgd"] == 4 * 8 + 8 + 8 * 3 + 3
    with pytest.raises(ValueError):
        store.load("d", "multiclass", "dp_sgd")
    with pytest.raises(FileNotFoundError):
        store.load("d", "binary", "xgboost")


def test_a_sweep_that_stops_goes_on_where_it_was(spark, data, tmp_path, monkeypatch):
    store = ModelStore(spark, f"{tmp_path}/models")
    fits = []
    real = train._families

    def counted(settings, seed, broken=()):
        def wrap(name, family):
            def fit(d, budgets):
                fits.append((name, tuple(budgets)))
                if name in broken:
                    raise KeyboardInterrupt
                return family.fit(d, budgets)
            return train.Family(fit, family.score)
        return {n: wrap(n, f) for n, f in real(settings, seed).items()}

    families = ("logistic_regression", "dp_logistic_regression", "dp_random_forest")
    monkeypatch.setattr(train, "_families", lambda *a: counted(*a, broken=("dp_random_forest",)))
    with pytest.raises(KeyboardInterrupt):
        train.run_models(data, "d", "multiclass", families, SMALL, 1, store)
    monkeypatch.setattr(train, "_families", counted)
    fits.clear()
    _, runs = train.run_models(data, "d", "multiclass", families, SMALL, 1, store)
    assert fits == [("dp_random_forest", (1.0, 50.0))]
    assert {r["model_name"]: r["status"] for r in runs.collect()} == {"logistic_regression": "loaded", "dp_logistic_regression": "loaded", "dp_random_forest": "trained"}
    fits.clear()
    wider = replace(SMALL, epsilons=(1.0, 5.0, 50.0))
    preds, _ = train.run_models(data, "d", "multiclass", families[1:], wider, 1, store)
    assert fits == [("dp_logistic_regression", (5.0,)), ("dp_random_forest", (5.0,))] and preds.count() == 300 * 6
    fits.clear()
    train.run_models(data, "d", "multiclass", families[:1], SMALL, 1, store, force=True)
    train.run_models(data, "d", "multiclass", families[:1], SMALL, 1, store, made_of="other data")
    assert len(fits) == 2


def test_a_family_that_fails_is_listed(spark, data, monkeypatch):
    def refuse(*a, **k):
        raise RuntimeError("no such luck")

    monkeypatch.setattr(train.dp_linear, "train", refuse)
    preds, runs = train.run_models(data, "d", "multiclass", ("logistic_regression", "dp_logistic_regression"), SMALL, 1)
    failed = runs.where("status = 'failed'").collect()
    assert [r["epsilon"] for r in failed] == [1.0, 50.0] and all(r["error"] == "RuntimeError: no such luck" for r in failed)
    assert preds.count() == 300
    with pytest.raises(RuntimeError):
        train.run_models(data, "d", "multiclass", ("dp_logistic_regression",), SMALL, 1)


def test_networks_are_scored_in_one_scan(spark, data):
    models = train.dp_mlp.train_sweep(data.train, "row_id", "features", "y", 3, (1.0, 5.0, 50.0), hidden=(8,), steps=5, epochs=1, seed=1)
    together = train.dp_mlp.predict_all(data.rows, list(models.values()))
    plan = together._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Union" not in plan
    one = {(r["epsilon"], r["row_id"]): tuple(r["probs"]) for m in models.values() for r in train.dp_mlp.predict(data.rows, m).collect()}
    got = {(r["epsilon"], r["row_id"]): tuple(r["probs"]) for r in together.collect()}
    assert got == one and len(got) == 900


def test_attacks_are_saved_and_failures_listed(spark, data, tmp_path):
    preds, runs = train.run_models(data, "d", "multiclass", ("logistic_regression", "random_forest", "dp_random_forest"), SMALL, 1)
    nan = F.transform("probs", lambda p: F.lit(float("nan")))
    preds = preds.withColumn("probs", F.when(F.col("model_name") == "random_forest", nan).otherwise(F.col("probs"))).cache()
    results = evaluate.result_rows(preds.where("model_name <> 'random_forest' AND split = 'test'"), runs, "multiclass")
    rows, root = data.rows.select("row_id", "split"), f"{tmp_path}/attacks"
    extra = runs.limit(1).withColumn("run_id", F.lit("d/multiclass/gone")).withColumn("model_name", F.lit("gone"))
    failed = mia.run_sweep(preds, rows, results, root, runs.unionByName(extra), fit_rows=50)
    assert {r["model_name"]: r["problem"] for r in failed.collect()} == {"random_forest": "features are not finite", "gone": mia.NO_ROWS}
    saved = ledger.load(spark, root, ATTACK_SCHEMA)
    assert sorted((r["target_model"], r["epsilon"] or 0) for r in saved.collect()) == [("dp_random_forest", 1.0), ("dp_random_forest", 50.0), ("logistic_regression", 0)]
    assert mia.run_sweep(preds, rows, results, root, runs.where("model_name <> 'random_forest'"), fit_rows=50).count() == 0
    assert ledger.load(spark, root, ATTACK_SCHEMA).agg(F.max("version")).first()[0] == 1
    assert set(MODEL_ORDER) >= {"xgboost", "dp_sgd"}
