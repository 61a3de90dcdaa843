"""Train every model family on a working subset and score all its rows.

The result is one long predictions table and one row per run, ready for the metric suite and the
membership attack. Private families train their whole budget grid at once where the mechanism
allows it. With a model store, a sweep resumes: finished models are loaded, the rest is trained.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinel.functions.cols import feature_columns
from sentinel.functions.storage import training_table
from sentinel.operators import baselines, dp_forest, dp_linear, dp_mlp, labels, scale
from sentinel.plans.evaluate import score_runs
from sentinel.schema import DEFAULTS, DP_MODELS, MODEL_ORDER, Settings, check_label_type
from sentinel.sources.models import ModelStore, PrivateForest, Stored, label_vectors, predict_forests
from sentinel.sources.tables import fingerprint


@dataclass(frozen=True)
class Prepared:
    """Scaled rows (row_id, split, features, y) of one data set and label type."""

    rows: DataFrame
    features: list[str]
    classes: list[str]
    scaler: DataFrame

    @property
    def train(self) -> DataFrame:
        return self.rows.where(F.col("split") == "train")


def prepare(subset: DataFrame, key: str = "row_id", label_type: str = "binary",
            scaled: bool = True) -> Prepared:
    """Features scaled by the training rows and an integer label; nothing is collected but the
    scaler and the class names."""
    check_label_type(label_type)
    features = [c for c in feature_columns(subset.columns) if c != key]
    is_train = F.col("split") == "train"
    scaler = scale.fit_scaler(subset.where(is_train), features)
    df = scale.apply_scaler(subset, scaler, features) if scaled else subset
    if label_type == "binary":
        classes, y = ["0", "1"], F.col("label_binary").cast("int")
    else:
        encoder = labels.fit_encoder(subset.where(is_train))
        classes = [r["label_multiclass"] for r in encoder.orderBy("code").collect()]
        df, y = labels.encode(df, encoder), F.col("code")
    rows = scale.assemble(df, features).select(
        F.col(key).alias("row_id"), "split", "features", y.alias("y"))
    return Prepared(training_table(rows), features, classes, scaler)


Budget = float | None


@dataclass(frozen=True)
class Family:
    """``fit`` trains the wanted budgets (None for families without one) and gives each model and the budget that it spends, where an
    accountant knows it; ``score`` gives the predictions of all models at once."""

    fit: Callable[[Prepared, Sequence[Budget]], dict[Budget, tuple[Stored, float | None]]]
    score: Callable[[DataFrame, dict[Budget, Stored]], DataFrame]


def _families(settings: Settings, seed: int | None) -> dict[str, Family]:

    def plain(train_one: Callable[[Prepared], Stored]) -> Family:
        return Family(lambda data, _: {None: (train_one(data), None)}, lambda rows, models: baselines.predict(models[None], rows, "features"))

    def fit_lr(data: Prepared, budgets: Sequence[Budget]) -> dict:
        bound = scale.norm_bound(data.train).first()["bound"]
        found = dp_linear.train(data.train, "features", "y", len(data.classes), bound, budgets, seed=seed)
        if not found.converged():
            raise RuntimeError(f"private logistic regression did not reach its minimum, residuals {found.residuals}")
        return {e: (replace(found, epsilons=(e,), weights=(w,), residuals=(r,)), None) for e, w, r in zip(found.epsilons, found.weights, found.residuals)}

    def score_lr(rows: DataFrame, models: dict) -> DataFrame:
        of = list(models.values())
        together = replace(of[0], epsilons=tuple(models), weights=tuple(m.weights[0] for m in of), residuals=tuple(m.residuals[0] for m in of))
        return dp_linear.predict(rows, together)

    def fit_rf(data: Prepared, budgets: Sequence[Budget]) -> dict:
        found = {r["feature"]: r for r in scale.feature_bounds(data.train, "features").collect()}
        d, k = len(data.features), len(data.classes)
        forest = dp_forest.random_forest_structure(d, seed=settings.seed)
        low, high = (tuple(found[i][side] for i in range(d)) for side in ("lower", "upper"))
        counts = dp_forest.leaf_counts(data.train, forest, "row_id", "y", k, [f"get(features, {i})" for i in range(d)], low, high, settings.seed)
        labels_at = label_vectors(dp_forest.noisy_labels(counts, budgets, seed))
        return {e: (PrivateForest(forest, low, high, labels_at[e], k), None) for e in labels_at}

    def score_rf(rows: DataFrame, models: dict) -> DataFrame:
        # models of one fit share their splits and bounds; a later fit may have other bounds
        shared: dict[tuple, dict] = {}
        for e, m in models.items():
            shared.setdefault((m.forest, m.lower, m.upper), {})[e] = m
        return reduce(DataFrame.unionByName, [predict_forests(rows, some) for some in shared.values()])

    def fit_sgd(data: Prepared, budgets: Sequence[Budget]) -> dict:
        found = dp_mlp.train_sweep(data.train, "row_id", "features", "y", len(data.classes), budgets, settings.delta,
                                   settings.hidden_layers, epochs=settings.epochs, clip=settings.max_grad_norm, seed=seed)
        return {e: (m, m.actual_epsilon) for e, m in found.items()}

    return {
        "logistic_regression": plain(lambda d: baselines.train_logistic(d.train, "features", "y")),
        "random_forest": plain(lambda d: baselines.train_forest(d.train, "features", "y", settings.n_trees, settings.tree_depth, settings.seed)),
        "xgboost": plain(lambda d: baselines.train_boosted(d.train, "features", "y", len(d.classes), settings.boosting_rounds, settings.tree_depth)),
        "dp_logistic_regression": Family(fit_lr, score_lr),
        "dp_random_forest": Family(fit_rf, score_rf),
        "dp_sgd": Family(fit_sgd, lambda rows, models: dp_mlp.predict_all(rows, list(models.values()))),
    }


@dataclass
class Outcome:
    """Models of one family with what is reported of each budget."""

    models: dict[Budget, Stored]
    notes: dict[Budget, dict]


def _obtain(family: Family, data: Prepared, name: str, budgets: Sequence[Budget], store: ModelStore | None, key: tuple[str, str], made_of: str,
            force: bool) -> Outcome:
    """Loads the finished models of a family and trains the rest, each stored as soon as its family is fitted."""
    out = Outcome({}, {})
    known = {e: store.manifest(*key, name, e) for e in budgets} if store and not force else {}
    for e, entry in known.items():
        if entry is not None and entry["fingerprint"] == made_of:
            out.models[e] = store.load(*key, name, e)
            out.notes[e] = {"status": "loaded", "actual_epsilon": entry["actual_epsilon"]}
    left = [e for e in budgets if e not in out.models]
    if not left:
        return out
    start = time.perf_counter()
    try:
        fitted = family.fit(data, left)
    except Exception as failure:  # reported with the run; the other families go on
        for e in left:
            out.notes[e] = {"status": "failed", "error": f"{type(failure).__name__}: {str(failure)[:500]}"}
        return out
    spent = round((time.perf_counter() - start) / len(left), 2)
    for e, (model, reached) in fitted.items():
        out.models[e], out.notes[e] = model, {"status": "trained", "actual_epsilon": reached, "train_time_s": spent}
        if store:
            store.save(model, *key, name, e, made_of, spent, reached)
    return out


RUN_SCHEMA = ("model_name string, epsilon double, delta double, actual_epsilon double, train_time_s double, public_bounds boolean, "
              "status string, error string")


def run_models(data: Prepared, dataset: str, label_type: str = "binary",
               models: Sequence[str] = MODEL_ORDER, settings: Settings = DEFAULTS,
               seed: int | None = None, store: ModelStore | None = None, force: bool = False, made_of: str = "") -> tuple[DataFrame, DataFrame]:
    """(predictions of all runs, runs) for the chosen families.

    With ``store``, models that are finished are loaded and only the rest is trained (all with ``force``); a model counts as finished if it was
    made from the same data (``made_of``, a fingerprint) with the same settings. A family that fails is listed in the runs with its error. ``train_time_s`` is
    NULL for models that were not trained now; a sweep trained in one go reports its time divided by its budgets.
    ``seed`` fixes the privacy noise and is for tests; by default it is secret.
    """
    families = _families(settings, seed)
    unknown = sorted(set(models) - set(families))
    if unknown:
        raise ValueError(f"unknown models: {unknown}")
    shared = {f: v for f, v in asdict(settings).items() if f not in ("epsilons", "attack_cap", "attack_test_ratio", "prob_feature_cutoff")}
    made_of = fingerprint(made_of, shared, data.features, data.classes)
    parts, rows = [], []
    for name in models:
        private = name in DP_MODELS
        budgets: list[Budget] = sorted(float(e) for e in settings.epsilons) if private else [None]
        got = _obtain(families[name], data, name, budgets, store, (dataset, label_type), made_of, force)
        if got.models:
            scored = families[name].score(data.rows, dict(sorted(got.models.items(), key=lambda m: m[0] or 0.0)))
            parts.append(score_runs(scored.withColumn("y_true", F.col("y")), dataset, label_type, name))
        rows += [(name, e, settings.delta if name == "dp_sgd" else None, got.notes[e].get("actual_epsilon"), got.notes[e].get("train_time_s"),
                  False if private else None, got.notes[e]["status"], got.notes[e].get("error")) for e in budgets]
    if not parts:
        raise RuntimeError("no model was trained: " + "; ".join(str(r[-1]) for r in rows))
    runs = data.rows.sparkSession.createDataFrame(rows, RUN_SCHEMA).withColumn("dataset", F.lit(dataset)).withColumn("label_type", F.lit(label_type))
    runs = runs.withColumn("run_id", F.concat_ws("/", "dataset", "label_type", "model_name", F.col("epsilon").cast("string")))
    return reduce(DataFrame.unionByName, parts), runs
