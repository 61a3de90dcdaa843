"""Comparison, tradeoff and findings tables over result rows.

``results`` has one row per (dataset, label_type, model_name, epsilon, split): some dozens per data
set. Reports group by (dataset, label_type), so any number of data sets is reported in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentinel.functions.cols import display_name, ratio, rnd, title_name
from sentinel.operators.metrics import utility_loss
from sentinel.operators.ranking import exact_quantiles, to_long
from sentinel.schema import COMPARISON_METRICS, DEGRADATION_METRICS, HEAT_METRICS

CELL = ["dataset", "label_type"]
LR, SGD, FOREST = "dp_logistic_regression", "dp_sgd", "dp_random_forest"


def private(results: DataFrame) -> DataFrame:
    return results.where(F.col("epsilon").isNotNull())


def public(results: DataFrame) -> DataFrame:
    return results.where(F.col("epsilon").isNull())


def family(model: str = "model_name") -> Column:
    return F.when(F.col("epsilon").isNull(), "Baseline").otherwise(display_name(model))


def run_label() -> Column:
    """'Random Forest', 'DP-LR ε=0.5'."""
    return F.when(F.col("epsilon").isNull(), title_name()).otherwise(
        F.concat(display_name(), F.lit(" ε="), F.col("epsilon").cast("string")))


def best_row(metric: str, *carried: str) -> Column:
    """Struct of the carried columns at the highest metric; ties go to the smallest name, epsilon."""
    order = F.struct((-F.coalesce(F.col(metric), F.lit(0.0))).alias("o"), F.col("model_name").alias("m"),
                     F.col("epsilon").alias("e"), *[F.col(c).alias(c) for c in carried])
    return F.min(order)


def best_baseline(results: DataFrame, metric: str = "f1_macro") -> DataFrame:
    """(dataset, label_type, base_model, base): the best non-private run."""
    return public(results).groupBy(*CELL).agg(best_row(metric).alias("_b")).select(
        *CELL, F.col("_b.m").alias("base_model"), (-F.col("_b.o")).alias("base"))


def lr_baseline(results: DataFrame, metric: str = "f1_macro") -> DataFrame:
    return public(results).where(F.col("model_name") == "logistic_regression").groupBy(*CELL).agg(
        F.max(metric).alias("base"))


# -- comparison and tradeoff -------------------------------------------------

def comparison_table(results: DataFrame, metrics: Sequence[str] = COMPARISON_METRICS,
                     with_loss: bool = False) -> DataFrame:
    """One row per run, scores to 4 places, baselines first, then ascending epsilon."""
    rows = results
    extra = []
    if with_loss:
        rows = rows.join(lr_baseline(results), CELL, "left")
        extra = [F.when(F.col("epsilon").isNotNull(), utility_loss(F.col("base"), F.col("f1_macro"))[1])
                 .alias("f1_loss_pct")]
    return rows.select(
        display_name().alias("model"), *CELL, "epsilon", *[rnd(m, 4).alias(m) for m in metrics],
        rnd("train_time_s", 1).alias("train_time_s"), *extra,
    ).orderBy("dataset", F.col("epsilon").asc_nulls_first(), "model")


def tradeoff_table(results: DataFrame, metric: str = "f1_macro") -> DataFrame:
    """Private runs with their loss against the non-private logistic regression."""
    loss, pct = utility_loss(F.col("base"), F.col(metric))
    return private(results).join(lr_baseline(results, metric), CELL, "left").select(
        *CELL, display_name().alias("model"), "epsilon", rnd(metric, 4).alias("score"),
        rnd("roc_auc", 4).alias("auc"), rnd("mcc", 4).alias("mcc"),
        loss.alias("loss_abs"), pct.alias("loss_pct"),
    ).orderBy(*CELL, "epsilon", "model")


def loss_bands(tradeoff: DataFrame) -> DataFrame:
    """green up to 5 % absolute loss, yellow up to 15 %, red above."""
    size = F.abs("loss_pct")
    band = F.when(size <= 5, "green").when(size <= 15, "yellow").when(size > 15, "red")
    return tradeoff.withColumn("band", band)


def key_findings(results: DataFrame) -> DataFrame:
    """Loss of each private run against the anchor, and whether it stays within 5 %."""
    loss = F.when(F.col("base") > 0, 100.0 * (F.col("base") - F.col("f1_macro")) / F.col("base"))
    best = best_baseline(results).select(*CELL, "base_model", F.col("base").alias("best_f1"))
    return private(results).join(lr_baseline(results), CELL).join(best, CELL).select(
        *CELL, F.col("base_model").alias("best_model"), rnd("best_f1", 4).alias("best_f1"),
        rnd("base", 4).alias("lr_f1"), display_name().alias("model"), "epsilon",
        rnd("f1_macro", 4).alias("f1_macro"), rnd(loss, 1).alias("loss_pct"),
        F.coalesce(loss <= 5.0, F.lit(False)).alias("within_5pct"))


def executive_summary(results: DataFrame, metric: str = "f1_macro") -> DataFrame:
    """Best run per family, its difference to the best baseline, and DP-SGD's smallest epsilon
    with less than 5 % loss."""
    base = best_baseline(results, metric).select(*CELL, "base")
    fam = family()
    best = results.withColumn("family", fam).groupBy(*CELL, "family").agg(
        best_row(metric).alias("_b")).select(
        *CELL, "family", F.col("_b.m").alias("model_name"), F.col("_b.e").alias("epsilon"),
        (-F.col("_b.o")).alias("score"))
    viable = min_epsilon_within(results, SGD, {"min_eps_5pct": 0.05}, metric)
    return best.join(base, CELL, "left").join(viable, CELL, "left").select(
        *CELL, "family", "model_name", "epsilon", rnd("score", 4).alias("score"),
        F.when((F.col("family") != "Baseline") & (F.col("base") > 0),
               rnd(100.0 * (F.col("score") - F.col("base")) / F.col("base"), 1)).alias("delta_pct"),
        "min_eps_5pct")


def degradation_matrix(results: DataFrame, metrics: Sequence[str] = DEGRADATION_METRICS) -> DataFrame:
    """Percent drop of every metric against the best baseline value of that metric."""
    best = public(results).groupBy(*CELL).agg(*[
        F.max(F.coalesce(F.col(m), F.lit(0.0))).alias(f"_{m}") for m in metrics])
    drop = lambda m: F.when(F.col(f"_{m}") > 0, 100.0 * (
        F.col(f"_{m}") - F.coalesce(F.col(m), F.lit(0.0))) / F.col(f"_{m}")).otherwise(0.0)
    return private(results).join(best, CELL).select(
        *CELL, display_name().alias("model"), "epsilon", *[rnd(drop(m), 4).alias(f"drop_{m}") for m in metrics])


# -- family against family ---------------------------------------------------

def _pair(results: DataFrame, left: str, right: str, columns: Sequence[str]) -> DataFrame:
    side = lambda model, tag: results.where(
        (F.col("model_name") == model) & F.col("epsilon").isNotNull()).select(
        *CELL, "epsilon", *[F.col(c).alias(f"{tag}_{c}") for c in columns])
    return side(left, "lr").join(side(right, "sgd"), [*CELL, "epsilon"])


def head_to_head(results: DataFrame, metric: str = "f1_macro") -> DataFrame:
    """DP-LR and DP-SGD at each shared epsilon with the strict winner."""
    p = _pair(results, LR, SGD, sorted({metric, "roc_auc", "mcc", "false_positive_rate"}))
    a, b = (F.coalesce(F.col(f"{t}_{metric}"), F.lit(0.0)) for t in ("lr", "sgd"))
    winner = F.when(b > a, "DP-SGD").when(a > b, "DP-LR").otherwise("Tie")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return p.select(
        *CELL, "epsilon", rnd(a, 4).alias("lr_score"), rnd(b, 4).alias("sgd_score"),
        rnd("lr_roc_auc", 4).alias("lr_auc"), rnd("sgd_roc_auc", 4).alias("sgd_auc"),
        rnd(zero("lr_mcc"), 4).alias("lr_mcc"), rnd(zero("sgd_mcc"), 4).alias("sgd_mcc"),
        rnd("lr_false_positive_rate", 4).alias("lr_fpr"), rnd("sgd_false_positive_rate", 4).alias("sgd_fpr"),
        winner.alias("winner"))


def win_counts(h2h: DataFrame) -> DataFrame:
    return h2h.groupBy(*CELL, "winner").agg(F.count(F.lit(1)).alias("n_epsilons"))


def head_to_head_regimes(results: DataFrame, margin: float = 0.001) -> DataFrame:
    """Wins beyond a margin, and DP-SGD's wins at epsilon <= 0.5 and >= 1."""
    p = _pair(results, LR, SGD, ["f1_macro"])
    a, b = F.col("lr_f1_macro"), F.col("sgd_f1_macro")
    sgd, lr = b > a + margin, a > b + margin
    low, high = F.col("epsilon") <= 0.5, F.col("epsilon") >= 1.0
    counts = p.groupBy(*CELL).agg(
        F.count_if(sgd).alias("sgd_wins"), F.count_if(lr).alias("lr_wins"),
        F.count_if(~sgd & ~lr).alias("ties"),
        F.count_if(low).alias("n_low"), F.count_if(low & sgd).alias("sgd_low_wins"),
        F.count_if(high).alias("n_high"), F.count_if(high & sgd).alias("sgd_high_wins"))
    overall = F.when(F.col("sgd_wins") > F.col("lr_wins"), "DP-SGD").when(
        F.col("lr_wins") > F.col("sgd_wins"), "DP-LR").otherwise("tied")
    return counts.withColumn("overall", overall)


# -- budget and time -----------------------------------------------------------

def budget_utilisation(results: DataFrame) -> DataFrame:
    rows = results.where((F.col("model_name") == SGD) & F.col("epsilon").isNotNull())
    return rows.select(
        *CELL, F.col("epsilon").alias("target_epsilon"), rnd("actual_epsilon", 4).alias("actual_epsilon"),
        rnd(100.0 * F.col("actual_epsilon") / F.col("epsilon"), 1).alias("used_pct"),
        rnd(F.col("epsilon") - F.col("actual_epsilon"), 4).alias("unused"),
        rnd("f1_macro", 4).alias("f1_macro"), rnd("roc_auc", 4).alias("roc_auc"),
        rnd("train_time_s", 1).alias("train_time_s"))


def train_time_summary(results: DataFrame) -> DataFrame:
    return results.groupBy(*CELL, "model_name").agg(
        F.count(F.lit(1)).alias("n_runs"), rnd(F.sum("train_time_s"), 2).alias("total_s"),
        rnd(F.avg("train_time_s"), 2).alias("mean_s"))


# -- operating points ------------------------------------------------------------

def fpr_dr_ranking(results: DataFrame) -> DataFrame:
    rows = results.where(F.col("false_positive_rate").isNotNull() & F.col("detection_rate").isNotNull())
    fpr, dr = rnd("false_positive_rate", 4), rnd("detection_rate", 4)
    return rows.select(
        *CELL, run_label().alias("model"), family().alias("type"), "epsilon", fpr.alias("fpr"),
        dr.alias("dr"), rnd(fpr / F.greatest(dr, F.lit(1e-9)), 4).alias("fpr_dr_ratio"),
    ).orderBy(*CELL, "fpr_dr_ratio", "model")


def precision_recall_points(results: DataFrame) -> DataFrame:
    rows = results.where(F.col("precision_macro").isNotNull() & F.col("recall_macro").isNotNull())
    return rows.select(*CELL, family().alias("type"), "epsilon", run_label().alias("label"),
                       rnd("precision_macro", 6).alias("precision"), rnd("recall_macro", 6).alias("recall"))


def metric_long(results: DataFrame, metrics: Sequence[str] = HEAT_METRICS) -> DataFrame:
    """(dataset, label_type, model, metric, value) of the baselines, missing values left out."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), rnd(m, 4).alias("value")) for m in metrics])
    return public(results).select(*CELL, title_name().alias("model"), F.inline(pairs)).where(
        "value IS NOT NULL")


def metric_matrix(results: DataFrame, metrics: Sequence[str] = HEAT_METRICS) -> DataFrame:
    return metric_long(results, metrics).groupBy(*CELL, "model").pivot("metric", list(metrics)).agg(
        F.first("value"))


# -- findings ----------------------------------------------------------------------

def best_overall(results: DataFrame, metric: str = "f1_macro") -> DataFrame:
    best = results.where(F.col(metric).isNotNull()).groupBy(*CELL).agg(best_row(metric).alias("_b"))
    return best.join(best_baseline(results, metric), CELL, "left").select(
        *CELL, F.col("_b.m").alias("best_model"), F.col("_b.e").alias("epsilon"),
        rnd(-F.col("_b.o"), 4).alias("score"), F.col("base_model"), rnd("base", 4).alias("base"),
        F.when(F.col("_b.e").isNotNull(), rnd(-F.col("_b.o") - F.col("base"), 4)).alias("gap"))


def privacy_cost(results: DataFrame, model: str = SGD, metric: str = "f1_macro") -> DataFrame:
    """Loss at the largest epsilon against the best baseline, with a verdict."""
    last = results.where((F.col("model_name") == model) & F.col("epsilon").isNotNull()).groupBy(*CELL).agg(
        F.max("epsilon").alias("max_epsilon"), F.max_by(metric, "epsilon").alias("_last"))
    cost = 100.0 * (F.col("base") - F.col("_last")) / F.col("base")
    verdict = (F.when(cost <= 2, "negligible").when(cost <= 5, "low").when(cost <= 15, "moderate")
               .when(cost > 15, "high"))
    return last.join(best_baseline(results, metric), CELL).where("base > 0").select(
        *CELL, "max_epsilon", rnd(cost, 4).alias("cost_pct"), verdict.alias("verdict"))


def min_epsilon_within(results: DataFrame, model: str, limits: dict[str, float],
                       metric: str = "f1_macro") -> DataFrame:
    """Smallest epsilon whose relative loss is strictly below each limit; NULL if none."""
    rows = results.where((F.col("model_name") == model) & F.col("epsilon").isNotNull()).join(
        best_baseline(results, metric), CELL)
    loss = F.when(F.col("base") > 0,
                  (F.col("base") - F.coalesce(F.col(metric), F.lit(0.0))) / F.col("base"))
    return rows.groupBy(*CELL).agg(*[
        F.min(F.when(loss < limit, F.col("epsilon"))).alias(name) for name, limit in limits.items()])


def min_viable_epsilon(results: DataFrame, model: str = SGD) -> DataFrame:
    return min_epsilon_within(results, model, {"min_eps_5pct": 0.05, "min_eps_10pct": 0.10})


def step_gains(results: DataFrame, metric: str = "f1_macro") -> DataFrame:
    """Gain of each private run over the next smaller epsilon of its family."""
    w = Window.partitionBy(*CELL, "model_name").orderBy("epsilon")
    return private(results).select(
        *CELL, "model_name", "epsilon", F.col(metric).alias("score"),
        F.lag("epsilon").over(w).alias("prev_epsilon"),
        (F.col(metric) - F.lag(metric).over(w)).alias("gain"),
        F.row_number().over(Window.partitionBy(*CELL, "model_name").orderBy(F.desc("epsilon"))).alias("from_end"))


def sharpest_transition(results: DataFrame, smallest: float = 0.005) -> DataFrame:
    """The epsilon pair with the largest gain per family, if that gain is worth reporting."""
    pick = F.max(F.struct("gain", (-F.col("epsilon")).alias("neg"), "prev_epsilon"))
    best = step_gains(results).where("gain > 0").groupBy(*CELL, "model_name").agg(pick.alias("_b"))
    return best.where(F.col("_b.gain") > smallest).select(
        *CELL, "model_name", F.col("_b.prev_epsilon").alias("from_epsilon"),
        (-F.col("_b.neg")).alias("to_epsilon"), rnd("_b.gain", 4).alias("gain"))


def noise_floor(results: DataFrame, metric: str = "f1_macro") -> DataFrame:
    """Score range from the smallest to the largest epsilon, its band, and whether the tail is flat."""
    g = step_gains(results, metric)
    tail = F.max(F.when(F.col("from_end") <= 3, F.abs("gain")))
    agg = g.groupBy(*CELL, "model_name").agg(
        F.count(F.lit(1)).alias("_n"), F.min_by("score", "epsilon").alias("_first"),
        F.max_by("score", "epsilon").alias("_last"), tail.alias("_tail"),
        F.max(F.when(F.col("from_end") == 3, F.col("epsilon"))).alias("_third"))
    spread = F.col("_last") - F.col("_first")
    band = F.when(spread < 0.05, "narrow").when(spread < 0.20, "moderate").otherwise("wide")
    flat = (F.col("_n") >= 4) & (F.col("_tail") < 0.005)
    return agg.where("_n >= 3").select(
        *CELL, "model_name", rnd("_first", 4).alias("score_first"), rnd("_last", 4).alias("score_last"),
        rnd(spread, 4).alias("score_range"), band.alias("band"), flat.alias("plateau"),
        F.when(flat, F.col("_third")).alias("plateau_from"))


def overview(results: DataFrame) -> DataFrame:
    """Best baseline, runs per family and DP-SGD's smallest epsilon within 10 %, per data set and label."""
    count = lambda m: F.count_if((F.col("model_name") == m) & F.col("epsilon").isNotNull())
    sizes = results.groupBy(*CELL).agg(count(LR).alias("n_dp_lr"), count(FOREST).alias("n_dp_rf"),
                                       count(SGD).alias("n_dp_sgd"))
    base = best_baseline(results).select(*CELL, title_name("base_model").alias("best_baseline"),
                                         rnd("base", 4).alias("best_f1"))
    viable = min_epsilon_within(results, SGD, {"min_eps_10pct": 0.10})
    return base.join(sizes, CELL).join(viable, CELL, "left")


# -- attack reports --------------------------------------------------------------------

def attack_table(attacks: DataFrame, columns: Sequence[str]) -> DataFrame:
    return attacks.select(
        *CELL, display_name("target_model").alias("model"), "epsilon", "n_members",
        *[rnd(c, 4).alias(c) for c in columns],
    ).orderBy(*CELL, "model", F.col("epsilon").asc_nulls_first())


def utility_risk_table(attacks: DataFrame) -> DataFrame:
    pick = {
        "f1_macro": "target_f1_macro", "ids_auc": "target_roc_auc", "fpr": "target_false_positive_rate",
        "detection_rate": "target_detection_rate", "attack_auc": "attack_roc_auc",
        "attack_advantage": "attack_advantage",
    }
    return attacks.select(
        *CELL, display_name("target_model").alias("model"), "epsilon",
        *[rnd(c, 4).alias(n) for n, c in pick.items()],
    ).orderBy(*CELL, "model", F.col("epsilon").asc_nulls_first())


def attack_summary(attacks: DataFrame, near_random: float = 0.55) -> DataFrame:
    """Mean attack AUC on non-private runs, lowest on private ones, and the smallest epsilon near 0.5."""
    auc, dp = F.col("attack_roc_auc"), F.col("epsilon").isNotNull()
    lowest = F.min(F.when(dp, F.struct(auc.alias("auc"), F.col("epsilon").alias("eps"))))
    return attacks.groupBy(*CELL).agg(
        F.avg(F.when(~dp, auc)).alias("_open"), lowest.alias("_low"),
        F.min(F.when(dp & (auc < near_random), F.col("epsilon"))).alias("min_eps_near_random"),
    ).select(
        *CELL, rnd("_open", 4).alias("open_attack_auc"), rnd("_low.auc", 4).alias("best_dp_attack_auc"),
        F.col("_low.eps").alias("best_dp_epsilon"),
        rnd(F.col("_open") - F.col("_low.auc"), 4).alias("reduction"), "min_eps_near_random")


def attack_series(attacks: DataFrame) -> DataFrame:
    return attacks.where(F.col("epsilon").isNotNull()).select(
        *CELL, display_name("target_model").alias("model"), "epsilon",
        rnd("attack_roc_auc", 4).alias("attack_auc"), rnd("attack_advantage", 4).alias("advantage"),
    ).orderBy(*CELL, "model", "epsilon")


# -- data overview ------------------------------------------------------------------------

def subset_stats(subset: DataFrame, n_features: int) -> DataFrame:
    """Row counts by split, class and binary label, plus totals, as (kind, value, n) rows."""
    counts = subset.groupBy("split", "label_multiclass", "label_binary").agg(F.count(F.lit(1)).alias("c"))
    kinds = F.array(
        F.struct(F.lit("split").alias("kind"), F.col("split").alias("value"), F.col("c").alias("n")),
        F.struct(F.lit("class").alias("kind"), F.col("label_multiclass").alias("value"), F.col("c").alias("n")),
        F.struct(F.lit("binary").alias("kind"), F.col("label_binary").cast("string").alias("value"),
                 F.col("c").alias("n")),
        F.struct(F.lit("total").alias("kind"), F.lit("rows").alias("value"), F.col("c").alias("n")))
    per_kind = counts.select(F.inline(kinds)).groupBy("kind", "value").agg(F.sum("n").alias("n"))
    features = counts.limit(1).select(
        F.lit("total").alias("kind"), F.lit("features").alias("value"), F.lit(n_features).cast("bigint").alias("n"))
    return per_kind.unionByName(features)


def class_imbalance(df: DataFrame) -> DataFrame:
    benign = F.count_if(F.col("label_binary") == 0)
    attack = F.count_if(F.col("label_binary") == 1)
    n = df.agg(benign.alias("n_benign"), attack.alias("n_attack"))
    both = F.col("n_benign") + F.col("n_attack")
    skew = F.greatest("n_benign", "n_attack") / F.least("n_benign", "n_attack")
    return n.where("n_benign > 0 AND n_attack > 0").select(
        F.when(F.col("n_benign") >= F.col("n_attack"), "Benign").otherwise("Attack").alias("majority"),
        rnd(skew, 4).alias("imbalance"), "n_benign", "n_attack",
        rnd(100.0 * F.col("n_benign") / both, 4).alias("benign_pct"),
        rnd(100.0 * F.col("n_attack") / both, 4).alias("attack_pct"),
        (skew > 5).alias("high"))


def split_class_counts(df: DataFrame) -> DataFrame:
    """Rows per (split, binary label) and per (split, class), in one pass."""
    return df.groupingSets(
        [["split", "label_binary"], ["split", "label_multiclass"]],
        "split", "label_binary", "label_multiclass",
    ).agg(F.count(F.lit(1)).alias("n_rows"))


def split_shares(df: DataFrame) -> DataFrame:
    counts = df.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))
    total = F.sum("n_rows").over(Window.partitionBy(F.lit(0)))  # three rows
    return counts.withColumn("share_pct", rnd(ratio(F.lit(100.0) * F.col("n_rows"), total), 4))


def feature_profile(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean, sample deviation, exact median, min, max and coefficient of variation per feature."""


    long = to_long(train, features).where(F.col("value").isNotNull())
    moments = long.groupBy("feature").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std_dev"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    median = exact_quantiles(long, [0.5]).select("feature", F.col("quantile").alias("median"))
    cv = F.col("std_dev") / F.greatest(F.abs("mean"), F.lit(1e-9)) * 100.0
    return moments.join(median, "feature").withColumn("cv_pct", cv)


def top_features(profile: DataFrame, by: str = "cv_pct", n: int = 20) -> DataFrame:
    return profile.orderBy(F.desc(by), "feature").limit(n)


def mean_histogram(profile: DataFrame, bins: int = 30) -> DataFrame:
    """Histogram of log10 |mean| over the features: (bin, low, n_features), empty bins left out."""
    logs = profile.select(F.log10(F.greatest(F.abs("mean"), F.lit(1e-9))).alias("v"))
    whole = Window.partitionBy(F.lit(0))  # one row per feature
    edged = logs.select("v", F.min("v").over(whole).alias("lo"), F.max("v").over(whole).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    spot = F.when(F.col("hi") > F.col("lo"), F.least(
        F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    return edged.groupBy(spot.cast("int").alias("bin")).agg(
        F.min(F.col("lo") + spot * width).alias("low"), F.count(F.lit(1)).alias("n_features"))
