"""Private models, accounting and the attack."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentinel.functions import storage
from sentinel.operators import accountant, attack, baselines, dp_forest, dp_linear, dp_mlp


@pytest.fixture(scope="module")
def points(spark):
    """600 rows, 6 features, label from a linear rule with some noise."""
    rng = np.random.default_rng(42)
    x = rng.normal(0, 1, (600, 6))
    y = (x @ np.array([2.0, -1.0, 0.5, 0, 0, 0]) + rng.normal(0, 0.5, 600) > 0).astype(int)
    y3 = np.argmax(x[:, :3], axis=1)
    rows = [(i, [float(v) for v in x[i]], int(y[i]), int(y3[i]), "train" if i < 400 else "test") for i in range(600)]
    return spark.createDataFrame(rows, "row_id long, features array<double>, y int, y3 int, split string").cache()


def accuracy(preds, label):
    return preds.where("split = 'test'").agg(F.avg((F.col("y_pred") == F.col(label)).cast("double"))).first()[0]


# -- accounting ----------------------------------------------------------------

def closed_rdp(q, s, a):
    t = [math.lgamma(a + 1) - math.lgamma(k + 1) - math.lgamma(a - k + 1)
         + ((a - k) * math.log(1 - q) if k < a else 0) + k * math.log(q) + (k * k - k) / (2 * s * s)
         for k in range(a + 1)]
    m = max(t)
    return (m + math.log(sum(math.exp(v - m) for v in t))) / (a - 1)


def test_rdp_matches_closed_form(spark):
    df = spark.createDataFrame([(0.01, 1.0), (0.2, 0.7), (1.0, 2.0)], "rate double, sigma double")
    for r in accountant.rdp(df, (2, 3, 8, 64, 512)).collect():
        a, s = r["alpha"], r["sigma"]
        want = a / (2 * s * s) if r["rate"] == 1.0 else closed_rdp(r["rate"], s, a)
        assert r["rdp"] == pytest.approx(want, rel=1e-9)


def test_epsilon_is_monotone(spark):
    plans = [(i, 0.01, s, t) for i, (s, t) in enumerate([(1.0, 1000), (1.0, 2000), (1.5, 1000), (1.0, 0)])]
    df = spark.createDataFrame(plans, "k int, rate double, sigma double, steps long")
    eps = {r["k"]: r["epsilon"] for r in accountant.spent_epsilon(df, ["k"], 1e-5).collect()}
    assert eps[1] > eps[0] > eps[2] > eps[3] >= 0
    assert eps[0] == pytest.approx(2.1078, abs=2e-2)


def test_noise_search_stays_within_target(spark):
    sigma = accountant.noise_for(spark, 0.05, 100, 1.0, 1e-5)
    df = spark.createDataFrame([(0, 0.05, sigma, 100), (1, 0.05, sigma * 0.97, 100)],
                               "k int, rate double, sigma double, steps long")
    eps = {r["k"]: r["epsilon"] for r in accountant.spent_epsilon(df, ["k"], 1e-5).collect()}
    assert 0.95 < eps[0] <= 1.0 < eps[1]


# -- forest -------------------------------------------------------------------------

BOUNDED = ([f"get(features, {i})" for i in range(6)], [-3.0] * 6, [3.0] * 6)


def routed(points, forest):
    return dp_forest.route(points, forest, *BOUNDED)


def test_forest_routing_and_counts(points):
    forest = dp_forest.random_forest_structure(6, n_trees=4, depth=3, seed=1)
    rows = routed(points, forest)
    for r in rows.limit(50).collect():
        for t in range(4):
            n = 0
            for _ in range(3):
                f = forest.features[t][n]
                n = 2 * n + 1 + int(r["features"][f] > -3.0 + forest.positions[t][n] * 6.0)
            assert r["leaves"][t] == n - 7
    counts = dp_forest.leaf_counts(points, forest, "row_id", "y3", 3, *BOUNDED, 1)
    assert counts.count() == 4 * 8 * 3
    assert counts.agg(F.sum("n")).first()[0] == 600  # every row counts once


def test_forest_large_epsilon_is_majority_and_noise_is_secret_by_default(points):
    forest = dp_forest.random_forest_structure(6, n_trees=4, depth=3, seed=1)
    counts = dp_forest.leaf_counts(points, forest, "row_id", "y", 2, *BOUNDED, 1).cache()
    table = {}
    for r in counts.collect():
        table.setdefault((r["tree"], r["leaf"]), {})[r["class"]] = r["n"]
    for r in dp_forest.noisy_labels(counts, [1e9], 7).collect():
        c = table[(r["tree"], r["leaf"])]
        assert c[r["label"]] == max(c.values())
    a, b = (dp_forest.noisy_labels(counts, [0.1]).agg(F.sum("score")).first()[0] for _ in range(2))
    assert a != b
    with pytest.raises(ValueError):
        dp_forest.noisy_labels(counts, [0.0])


def test_forest_votes(points):
    forest = dp_forest.random_forest_structure(6, n_trees=10, depth=5, seed=3)
    rows = routed(points, forest)
    counts = dp_forest.leaf_counts(points.where("split = 'train'"), forest, "row_id", "y", 2, *BOUNDED, 1)
    preds = dp_forest.predict(rows, forest, dp_forest.noisy_labels(counts, [0.01, 100.0], 7), 2).cache()
    assert preds.count() == 1200
    assert preds.where("abs(probs[0] + probs[1] - 1) > 1e-9").count() == 0
    assert accuracy(preds.where("epsilon = 100"), "y") > 0.6


# -- linear ---------------------------------------------------------------------------

def test_linear_without_noise_matches_newton(points):
    models = dp_linear.train(points, "features", "y", 2, 1e6, [None, 1e9], max_iter=100, tol=1e-9)
    x = np.array([r["features"] for r in points.collect()])
    y = np.array([r["y"] for r in points.collect()])
    w = np.zeros(7)
    a = np.column_stack([x, np.ones(600)])
    for _ in range(50):  # same objective: the constant is regularised like a feature
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.eye(7), a.T @ (p - y) + w)
    assert np.allclose(models.weights[0][0], w, atol=1e-4)


def test_linear_private_sweep(points):
    train = points.where("split = 'train'")
    models = dp_linear.train(train, "features", "y", 2, 4.0, [0.01, 1.0, 100.0, None], max_iter=60, seed=3)
    preds = dp_linear.predict(points, models).cache()
    acc = {e: accuracy(preds.where(F.col("epsilon").eqNullSafe(F.lit(e).cast("double"))), "y")
           for e in (0.01, 100.0, None)}
    assert acc[None] > 0.88 and acc[100.0] > 0.8 and acc[0.01] < acc[None]
    with pytest.raises(ValueError):
        dp_linear.train(train, "features", "y", 2, 4.0, [0.0])


def test_linear_multiclass_and_balanced(points):
    models = dp_linear.train(points, "features", "y3", 3, 4.0, [None], max_iter=60, balanced=True)
    preds = dp_linear.predict(points, models)
    assert accuracy(preds, "y3") > 0.85
    assert preds.where("abs(probs[0] + probs[1] + probs[2] - 1) > 1e-9").count() == 0


# -- network ---------------------------------------------------------------------------

def test_clipped_gradient_against_differences():
    rng = np.random.default_rng(0)
    shapes = ((3, 4), (4, 2))
    theta = dp_mlp.initial_weights(shapes, rng)
    x, y, w = rng.normal(0, 1, (5, 3)), np.array([0, 1, 1, 0, 1]), np.array([1.0, 2, 1, 0.5, 1])

    def loss(t, rows):
        return dp_mlp.clipped_gradient(x[rows], y[rows], w[rows], t, shapes, 1e9)[1]

    for rows in ([0], [1, 2, 3, 4]):
        grad, _ = dp_mlp.clipped_gradient(x[rows], y[rows], w[rows], theta, shapes, 1e9)
        for k in range(0, len(theta), 3):
            step = np.zeros_like(theta)
            step[k] = 1e-6
            assert grad[k] == pytest.approx((loss(theta + step, rows) - loss(theta - step, rows)) / 2e-6, abs=1e-5)
    for i in range(5):
        g, _ = dp_mlp.clipped_gradient(x[[i]], y[[i]], w[[i]], theta, shapes, 0.1)
        assert np.linalg.norm(g) <= 0.1 + 1e-9


def test_network_learns_and_reports_its_budget(points):
    model = dp_mlp.train(points.where("split = 'train'"), "row_id", "features", "y", 2, epsilon=50.0,
                         hidden=(16,), steps=12, rate=0.5, lr=0.05, seed=1)
    assert 0 < model.actual_epsilon <= 50.0
    preds = dp_mlp.predict(points, model)
    assert accuracy(preds, "y") > 0.75
    with pytest.raises(ValueError):
        dp_mlp.train(points, "row_id", "features", "y", 2, epsilon=0.0)


def test_sweep_shares_lots_and_leaves_nothing_behind(spark, points, monkeypatch):
    jobs, written = [], []
    real_sum, real_lots = dp_mlp.sum_partials, dp_mlp._stored_lots
    monkeypatch.setattr(dp_mlp, "sum_partials", lambda *a: jobs.append(1) or real_sum(*a))
    monkeypatch.setattr(dp_mlp, "_stored_lots", lambda *a: written.append(real_lots(*a).count()) or real_lots(*a[:-1], a[-1] + "b"))
    fit = points.where("split = 'train'")
    models = dp_mlp.train_sweep(fit, "row_id", "features", "y", 2, (0.5, 5.0, 50.0), hidden=(8,), steps=6, rate=0.5, lr=0.05, seed=1, window=4)
    assert sorted(models) == [0.5, 5.0, 50.0] and len(jobs) == 6 and len(written) == 2
    assert sum(written) < 0.75 * 6 * fit.count()
    assert all(0 < m.actual_epsilon <= e for e, m in models.items())
    assert models[0.5].sigma > models[5.0].sigma > models[50.0].sigma
    assert np.array_equal(models[5.0].theta, dp_mlp.train_sweep(
        fit, "row_id", "features", "y", 2, (0.5, 5.0, 50.0), hidden=(8,), steps=6, rate=0.5, lr=0.05, seed=1)[5.0].theta)
    assert not [n for n in storage.list_dir(spark, storage.shared_dir(spark)) if n.startswith("lots-")]


def test_forest_runs_without_code_generation_fallback(spark, points):
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        forest = dp_forest.random_forest_structure(6, n_trees=10, depth=8)
        counts = dp_forest.leaf_counts(points, forest, "row_id", "y", 2, *BOUNDED, 1)
        votes = dp_forest.noisy_labels(counts, (1.0, 10.0), 1)
        assert dp_forest.predict(dp_forest.route(points, forest, *BOUNDED), forest, votes, 2).count() == 2 * points.count()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


def test_lots_are_poisson_samples(spark):
    lots = dp_mlp.assign_lots(spark.range(2000).withColumnRenamed("id", "k"), "k", 0.1, 1, 20, "s")
    sizes = [r["count"] for r in lots.groupBy("step").count().collect()]
    assert len(sizes) == 20 and all(130 < n < 270 for n in sizes) and len(set(sizes)) > 1


def test_real_orders(spark):
    """Whole orders agree with the finite sum; others with numerical integration; the epsilon is never larger."""
    q, s = np.array([0.01, 0.2, 0.6, 0.01]), np.array([1.1, 0.7, 2.0, 0.3])
    for a in (2, 3, 8, 32):
        got = accountant.log_moment(q, s, np.full(4, float(a))) / (a - 1)
        assert got == pytest.approx([closed_rdp(x, y, a) for x, y in zip(q, s)], rel=1e-7)
    x = np.linspace(-60, 60, 2_000_001)
    for rate, sigma, a in ((0.3, 1.0, 1.5), (0.05, 2.0, 2.5), (0.9, 1.5, 1.1), (0.5, 3.0, 7.3)):
        ratio = (1 - rate) + rate * np.exp((2 * x - 1) / (2 * sigma**2))
        want = np.log(np.trapezoid(np.exp(-x**2 / (2 * sigma**2)) / (sigma * np.sqrt(2 * np.pi)) * ratio**a, x))
        assert accountant.log_moment(np.array([rate]), np.array([sigma]), np.array([a]))[0] == pytest.approx(want, rel=1e-6)
    df = spark.createDataFrame([("a", 0.5, 0.3, 30), ("b", 1.0, 0.5, 2), ("c", 0.01, 4.0, 10)], "k string, rate double, sigma double, steps long")
    whole, real = ({r["k"]: r for r in accountant.spent_epsilon(df, ["k"], 1e-5, real_orders=o).collect()} for o in ((), accountant.REAL_ORDERS))
    assert all(real[k]["epsilon"] <= whole[k]["epsilon"] + 1e-12 for k in whole)
    assert real["a"]["epsilon"] < whole["a"]["epsilon"] and real["a"]["best_alpha"] < 2
    ones = accountant.rdp_real(df.where("rate = 1"), (1.5, 2.25)).collect()
    assert sorted(r["rdp"] for r in ones) == pytest.approx([1.5 / 0.5, 2.25 / 0.5])
    with pytest.raises(ValueError):
        accountant.rdp_real(df, (1.0,))


# -- baselines ----------------------------------------------------------------------------

def test_baselines_agree_on_an_easy_problem(points):
    train = points.where("split = 'train'")
    fitted = {
        "lr": baselines.train_logistic(train, "features", "y"),
        "rf": baselines.train_forest(train, "features", "y", n_trees=10, depth=5),
        "gbt": baselines.train_boosted(train, "features", "y", 2, rounds=5, depth=3),
    }
    for m in fitted.values():
        assert accuracy(baselines.predict(m, points, "features"), "y") > 0.8
    top = baselines.feature_importances(fitted["rf"], points, list("abcdef")).collect()
    assert top[0]["feature"] == "a" and sum(r["importance"] for r in top) == pytest.approx(1.0)


# -- attack ----------------------------------------------------------------------------------

def test_attack_sample(spark):
    rows = spark.range(900).select(F.col("id").alias("row_id"), F.when(F.col("id") < 600, "train").when(
        F.col("id") < 650, "val").otherwise("test").alias("split"))
    both = rows.withColumn("dataset", F.lit("a")).union(rows.where("row_id % 2 = 0").withColumn("dataset", F.lit(None)))
    s = attack.attack_sample(both, "row_id", fit_rows=100).collect()
    for name, n, held in (("a", 250, 75), (None, 125, 38)):
        own = [r for r in s if r["dataset"] == name]
        assert sum(r["member"] for r in own) == n and len(own) == 2 * n
        assert {p: sum(r["part"] == p for r in own) for p in ("test", "train", "spare")} == {
            "test": 2 * held, "train": 2 * min(100, n - held), "spare": 2 * max(n - held - 100, 0)}
    assert {r["split"] for r in s} == {"train", "test"}
    again = {(r["dataset"], r["row_id"], r["part"]) for r in attack.attack_sample(both.repartition(3), "row_id", fit_rows=100).collect()}
    assert again == {(r["dataset"], r["row_id"], r["part"]) for r in s}
    assert again != {(r["dataset"], r["row_id"], r["part"]) for r in attack.attack_sample(both, "row_id", fit_rows=100, seed=1).collect()}


def test_attack_features(spark):
    df = spark.createDataFrame([(0, 0, [1.0, 0.0]), (1, 0, [0.5, 0.5])], "y_true int, y_pred int, probs array<double>")
    a, b = attack.attack_features(df).collect()
    assert len(a["attack_features"]) == 6 and a["loss"] == 0.0 and a["correct"] == 1.0
    assert b["entropy"] == pytest.approx(math.log(2)) and b["loss"] == pytest.approx(math.log(2))
    only = attack.attack_features(df.drop("probs")).first()
    assert only["attack_features"] == [1.0]


def test_attack_finds_a_leak_and_nothing_without_one(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(800):
        member, part = i % 2, "test" if i % 10 < 3 else "train"
        for run, shift in (("leaky", 2.0), ("safe", 0.0)):
            rows.append((run, i, member, part, [float(v) for v in rng.normal(member * shift, 1, 3)]))
    df = spark.createDataFrame(rows, "run_id string, row_id long, member int, part string, attack_features array<double>")
    broken = df.where("run_id = 'safe'").withColumn("run_id", F.lit("broken")).withColumn("attack_features", F.array(F.lit(float("nan"))))
    m = {r["run_id"]: r for r in attack.attack_metrics(attack.attack_scores(df.union(broken), ["run_id"], "row_id"), ["run_id"]).collect()}
    assert set(m) == {"leaky", "safe"}
    assert m["leaky"]["attack_roc_auc"] > 0.95 and abs(m["safe"]["attack_roc_auc"] - 0.5) < 0.12
    for r in m.values():
        assert r["attack_advantage"] == pytest.approx(r["attack_roc_auc"] - 0.5, abs=6e-5)
        assert 0 <= r["tpr_at_fpr_0_01"] <= r["tpr_at_fpr_0_10"] <= 1


def test_model_round_trip(spark, points, tmp_path):
    model = baselines.train_forest(points, "features", "y", n_trees=3, depth=3)
    baselines.save_model(model, f"{tmp_path}/m")
    again = baselines.load_model(spark, f"{tmp_path}/m")
    a, b = (baselines.predict(m, points, "features").select("row_id", "probs") for m in (model, again))
    assert a.exceptAll(b).count() == 0
    with pytest.raises(FileNotFoundError):
        baselines.load_model(spark, f"{tmp_path}/none")


def test_all_families_end_to_end(spark, points):
    from dataclasses import replace

    from sentinel.plans import evaluate, mia, train
    from sentinel.schema import ATTACK_SCHEMA, DEFAULTS

    subset = points.select("row_id", "split", *[F.col("features")[i].alias(f"f{i}") for i in range(6)],
                           F.col("y").cast("tinyint").alias("label_binary"),
                           F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), F.col("y3") + 1).alias("label_multiclass"))
    data = train.prepare(subset, label_type="multiclass")
    assert data.classes == ["A", "B", "C"] and data.features == [f"f{i}" for i in range(6)]
    small = replace(DEFAULTS, epsilons=(1.0, 50.0), n_trees=5, tree_depth=3, hidden_layers=(8,), epochs=3)
    preds, runs = train.run_models(data, "points", "multiclass", (
        "logistic_regression", "random_forest", "dp_logistic_regression", "dp_random_forest"), small, seed=1)
    preds = preds.cache()
    assert preds.count() == 600 * 6
    res = evaluate.result_rows(preds.where("split = 'test'"), runs, "multiclass")
    score = {(r["model_name"], r["epsilon"]): r["f1_macro"] for r in res.collect()}
    assert len(score) == 6 and score[("logistic_regression", None)] > 0.85
    assert score[("dp_logistic_regression", 50.0)] > score[("dp_logistic_regression", 1.0)]
    done = spark.createDataFrame([], ATTACK_SCHEMA)
    found = mia.sweep(preds, subset.select("row_id", "split"), res, done, fit_rows=100).collect()
    assert len(found) == 6 and all(r["n_members"] == 200 and r["n_attack_test"] == 120 and r["n_attack_train"] == 200 for r in found)
    with pytest.raises(ValueError):
        train.run_models(data, "points", models=("svm",))
    with pytest.raises(ValueError):
        train.prepare(subset, label_type="other")
