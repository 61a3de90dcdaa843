"""Black-box membership inference against all runs at once.

Member and non-member rows are chosen by row key alone, so every target model of a data set is attacked
on the same rows. All balanced rows take part; only the number of rows that fit an attacker is bounded,
which is what makes one small fit per run a safe grouped task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentinel.functions.cols import rnd
from sentinel.functions.rand import uniform
from sentinel.functions.storage import cut_lineage, small_table
from sentinel.operators import curves
from sentinel.operators.metrics import per_class
from sentinel.operators.ranking import mark_smallest, smallest_cuts
from sentinel.schema import DEFAULTS


def attack_sample(rows: DataFrame, key: str, groups: Sequence[str] = ("dataset",), fit_rows: int = DEFAULTS.attack_cap,
                  seed: int = 42) -> DataFrame:
    """(groups, key, split, member, part): as many train as test rows, per data set (``groups``).

    ``rows`` has one row per record with ``split``. Of each side a share is held out to be scored (part test). Of the
    rest, at most ``fit_rows`` per side fit the attacker (part train); more rows would not make a small model better and
    their number bounds the task that fits. Rows beyond that are listed as spare.
    """
    groups = list(groups)
    sides, quotas = _sides(rows, key, groups, fit_rows, seed)
    marked = mark_smallest(sides, [*groups, "split"], "_draw", key, quotas)
    return marked.where("_in").select(
        *groups, key, "split", F.when(F.col("split") == "train", 1).otherwise(0).alias("member"),
        F.when(F.col("_held"), "test").when(F.col("_used"), "train").otherwise("spare").alias("part"))


def _group_name(columns: Sequence[str]) -> Column:
    return F.concat_ws("\u0001", *[F.coalesce(F.col(g).cast("string"), F.lit("\u0000")) for g in columns], F.lit(""))


def _sides(rows: DataFrame, key: str, groups: list[str], fit_rows: int, seed: int) -> tuple[DataFrame, dict]:
    """Train and test rows with their draws, and the quotas of a sample."""
    sides = rows.where(F.col("split").isin("train", "test")).select(*groups, key, "split")
    name = _group_name(groups)
    sizes: dict[str, dict[str, int]] = {}
    for r in sides.groupBy(name.alias("group"), "split").count().collect():  # two rows per data set
        sizes.setdefault(r["group"], {})[r["split"]] = r["count"]
    n = {g: min(s.get("train", 0), s.get("test", 0)) for g, s in sizes.items()}
    held = {g: int(k * DEFAULTS.attack_test_ratio + 0.5) for g, k in n.items()}
    used = {g: held[g] + min(k - held[g], fit_rows) for g, k in n.items()}

    def quota(of: dict[str, int]):
        pairs = [F.lit(x) for pair in of.items() for x in pair] or [F.lit(""), F.lit(0)]
        return lambda _: F.coalesce(F.try_element_at(F.create_map(*pairs), name), F.lit(0))

    return sides.withColumn("_draw", _draw(seed, key)), {"_in": quota(n), "_held": quota(held), "_used": quota(used)}


def _draw(seed: int, key: str) -> Column:
    return uniform(seed, "member", "split", key)


def sample_conditions(rows: DataFrame, key: str, groups: Sequence[str] = ("dataset",), fit_rows: int = DEFAULTS.attack_cap,
                      seed: int = 42) -> dict[str, Column]:
    """The sample of :func:`attack_sample` as conditions on (groups, key, split): in the sample at all (``any``), to be scored (``test``), to fit (``train``).

    They compare a row's own draw with the last one taken of its side, two constants per data set and quota, so they can be applied to any table
    with these columns, before its rows are multiplied and without a join. They do not ask whether ``rows`` has the key.
    """
    groups = list(groups)
    sides, quotas = _sides(rows, key, groups, fit_rows, seed)
    strata = [*groups, "split"]
    cuts = smallest_cuts(sides, strata, "_draw", key, quotas).select(
        _group_name(strata).alias("name"), *[F.col(f"_cut_{q}.{f}").alias(f"{q}{f}") for q in quotas for f in ("_u", "_k")]).collect()
    kind = rows.schema[key].dataType

    def upto(q: str) -> Column:
        known = [r for r in cuts if r[f"{q}_u"] is not None]
        if not known:
            return F.lit(False)
        last = F.create_map(*[x for r in known for x in (F.lit(r["name"]), F.struct(F.lit(r[f"{q}_u"]).alias("_u"), F.lit(r[f"{q}_k"]).cast(kind).alias("_k")))])
        own = F.struct(_draw(seed, key).alias("_u"), F.col(key).cast(kind).alias("_k"))
        return F.coalesce(own <= F.try_element_at(last, _group_name(strata)), F.lit(False))

    there = F.col("split").isin("train", "test")
    for c in (*groups, key):
        there = there & F.col(c).isNotNull()
    return {"any": there & upto("_in"), "test": there & upto("_in") & upto("_held"), "train": there & upto("_in") & ~upto("_held") & upto("_used")}


def attack_features(preds: DataFrame, cutoff: int = DEFAULTS.prob_feature_cutoff) -> DataFrame:
    """Add max_conf, entropy, loss, correct and the feature array ``attack_features``."""
    correct = (F.col("y_true") == F.col("y_pred")).cast("double")
    if "probs" not in preds.columns:
        return preds.withColumn("correct", correct).withColumn("attack_features", F.array("correct"))
    clip = lambda p: F.least(F.greatest(p, F.lit(1e-10)), F.lit(1.0))
    k = F.size("probs")
    entropy = -F.aggregate("probs", F.lit(0.0), lambda a, p: a + clip(p) * F.ln(clip(p)))
    at = F.least(F.greatest(F.col("y_true"), F.lit(0)), k - 1)
    out = (
        preds.withColumn("max_conf", F.array_max("probs")).withColumn("entropy", entropy)
        .withColumn("loss", -F.ln(clip(F.get("probs", at)))).withColumn("correct", correct)
    )
    base = F.array("max_conf", "entropy", "loss", "correct")
    return out.withColumn("attack_features", F.when(k <= cutoff, F.concat(base, F.col("probs"))).otherwise(base))


def fit_logistic(x: np.ndarray, y: np.ndarray, c: float = 1.0, max_iter: int = 1000) -> np.ndarray:
    """L2 logistic regression with free intercept by Newton steps; intercept last."""
    a = np.column_stack([x, np.ones(len(x))])
    penalty = np.append(np.full(x.shape[1], 1.0 / c), 0.0)

    def value(w):
        z = a @ w
        return np.logaddexp(0.0, z).sum() - y @ z + 0.5 * (penalty * w * w).sum()

    w = np.zeros(a.shape[1])
    now = value(w)
    for _ in range(max_iter):
        p = 1.0 / (1.0 + np.exp(-np.clip(a @ w, -700, 700)))
        grad = a.T @ (p - y) + penalty * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty + 1e-10)
        move = np.linalg.solve(hess, grad)
        size = 1.0
        while size > 1e-8 and value(w - size * move) > now:
            size /= 2
        w = w - size * move
        before, now = now, value(w)
        if before - now < 1e-10 * max(1.0, abs(now)):
            break
    return w


NOT_FINITE, ONE_SIDE, SINGULAR = "features are not finite", "only one side has fitting rows", "the fit is singular"


def fit_attackers(sampled: DataFrame, keys: Sequence[str], key: str) -> DataFrame:
    """(keys, mean, scale, weights, problem) of every run with fitting rows; ``problem`` says why an attacker could not be fitted.

    Only the fitting rows, a bounded number per run, are grouped.
    """
    keys = list(keys)

    def per_run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["member", key])
        x, y = np.stack(pdf["attack_features"].to_numpy()), pdf["member"].to_numpy(dtype=float)
        problem = NOT_FINITE if not np.isfinite(x).all() else ONE_SIDE if y.min() == y.max() else None
        mean = sd = w = None
        if problem is None:
            mean, sd = x.mean(0), x.std(0)
            sd = np.where(sd == 0, 1.0, sd)
            try:
                w = fit_logistic((x - mean) / sd, y)
            except np.linalg.LinAlgError:
                problem = SINGULAR
        return pdf.iloc[:1][keys].assign(mean=[mean], scale=[sd], weights=[w], problem=[problem])

    fit = sampled.where("part = 'train'").select(*keys, key, "member", "attack_features")
    columns = ", ".join(f"`{c}` {t}" for c, t in sampled.select(*keys).dtypes)
    return fit.groupBy(*keys).applyInPandas(per_run, f"{columns}, mean array<double>, scale array<double>, weights array<double>, problem string")


def attack_scores(sampled: DataFrame, keys: Sequence[str], key: str, attackers: DataFrame | None = None) -> DataFrame:
    """Fit the attacker per run and score its test rows: (keys, key, member, y_pred, score).

    ``sampled`` holds (keys, key, member, part, attack_features). The parameters of :func:`fit_attackers` are joined to the rows to be
    scored. A run whose attacker cannot be fitted has no scores and does not stop the others.
    """
    keys = list(keys)
    attackers = fit_attackers(sampled, keys, key) if attackers is None else attackers
    models = small_table(attackers.where("problem IS NULL").drop("problem"))  # a row per run
    test = sampled.where("part = 'test'").select(*keys, key, "member", "attack_features").join(models, keys)
    scaled = F.zip_with(F.zip_with("attack_features", "mean", lambda v, m: v - m), "scale", lambda v, s: v / s)
    terms = F.zip_with(scaled, F.slice("weights", F.lit(1), F.size("attack_features")), lambda v, w: v * w)
    z = F.aggregate(terms, F.element_at("weights", -1), lambda a, v: a + v)
    score = 1.0 / (1.0 + F.exp(-F.greatest(F.least(z, F.lit(700.0)), F.lit(-700.0))))
    return test.withColumn("score", score).select(*keys, key, "member", "score", F.when(F.col("score") > 0.5, 1).otherwise(0).alias("y_pred"))


def _packed(scores: DataFrame, keys: list[str], counted: Sequence[str] = ()) -> DataFrame:
    return cut_lineage(curves.pack_scores(scores, keys, F.col("member"), F.array("score"), counted, first_class=1))


def tpr_at_fpr(scores: DataFrame, keys: Sequence[str], limits: dict[str, float]) -> DataFrame:
    """Largest TPR on the full ROC curve with FPR <= limit, per run; 0 if there is none."""
    return curves.highest_tpr(_packed(scores, list(keys)), keys, limits)


def attack_metrics(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Accuracy, precision, recall, F1 of the member class, AUC, advantage, TPR at low FPR. The scores are read once."""
    keys = list(keys)
    packed = _packed(scores.withColumn("y_true", F.col("member")), keys, ["y_true", "y_pred"])
    classes = per_class(curves.counts(packed, keys, ["y_true", "y_pred"]), keys)
    member = lambda c: F.coalesce(F.max(F.when(F.col("class") == 1, F.col(c))), F.lit(0.0))
    base = classes.groupBy(*keys).agg(
        F.sum("support").alias("n_attack_test"),
        (F.sum("tp") / F.sum("support")).alias("attack_accuracy"),
        member("precision").alias("attack_precision"), member("recall").alias("attack_recall"),
        member("f1").alias("attack_f1"))
    curve = curves.highest_tpr(packed, keys, {"tpr_at_fpr_0_01": 0.01, "tpr_at_fpr_0_10": 0.10}, "attack_roc_auc")
    advantage = rnd(F.col("attack_roc_auc") - F.lit(0.5), 4).alias("attack_advantage")
    return base.join(curve.select(*keys, "attack_roc_auc", advantage, "tpr_at_fpr_0_01", "tpr_at_fpr_0_10"), keys)
