"""Membership-inference sweep over all runs that have no attack record yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentinel.functions.storage import cut_lineage, small_table
from sentinel.operators import attack
from sentinel.schema import ATTACK_SCHEMA, DEFAULTS
from sentinel.sources import ledger

RUN = ["run_id"]
ROW = ["dataset", "row_id", "split"]  # key of a record in predictions, rows and sample; stored in buckets of it they join without a shuffle


def sampled_features(preds: DataFrame, sample: DataFrame) -> DataFrame:
    """Attack features of the sampled rows, for every run of the data set they belong to.

    Predictions are never broadcast: they hold a row per run, which the planner does not see where they are multiplied on the way. A small
    sample is broadcast, unless the session forbids it; a large one meets them by sorted keys, without a shuffle where both are in buckets.
    """
    shared = [c for c in sample.columns if c not in ("member", "part")]
    broadcasts = preds.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"
    few = small_table(sample) if broadcasts else sample
    return attack.attack_features(preds.hint("merge").join(sample, shared) if few is sample else preds.join(few, shared))


def attack_runs(preds: DataFrame, rows: DataFrame, fit_rows: int = DEFAULTS.attack_cap,
                seed: int = DEFAULTS.seed) -> DataFrame:
    """Attack metrics per run_id. ``rows`` lists the records of every data set with their split, once each."""
    return _attacked(preds, rows, fit_rows, seed)[0]


def _attacked(preds: DataFrame, rows: DataFrame, fit_rows: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Metrics of the runs that could be attacked, and the attackers of all runs.

    Predictions are neither shuffled nor stored: conditions on a record's own key tell its part, so the rows that fit and the rows that are scored
    are read where they are needed, and what is stored of a scored row is its score.
    """
    groups = [c for c in ("dataset", "label_type") if c in rows.columns]
    key = [*groups, "row_id", "split"]
    chosen = attack.sample_conditions(rows, "row_id", groups, fit_rows, seed)
    odd = _met_not_once(preds, rows, key, chosen["any"])
    member = F.when(F.col("split") == "train", 1).otherwise(0).alias("member")

    def part(name: str) -> DataFrame:
        met = attack.attack_features(_as_often(preds.where(chosen[name]), odd, key))
        return met.select(*RUN, "row_id", member, F.lit(name).alias("part"), "attack_features")

    fit = cut_lineage(part("train"))  # a bounded number of rows per run
    attackers = cut_lineage(attack.fit_attackers(fit, RUN, "row_id"))
    metrics = attack.attack_metrics(attack.attack_scores(part("test"), RUN, "row_id", attackers), RUN)
    sides = _as_often(preds.where(chosen["any"]), odd, key).groupBy(*RUN).agg(
        F.sum(member).cast("bigint").alias("n_members"), F.sum(1 - member).cast("bigint").alias("n_non_members"))
    fitting = fit.groupBy(*RUN).agg(F.count(F.lit(1)).alias("n_attack_train"))
    sizes = sides.join(fitting, RUN, "left").withColumn("n_attack_train", F.coalesce("n_attack_train", F.lit(0).cast("bigint")))
    return metrics.join(sizes, RUN), attackers


def _met_not_once(preds: DataFrame, rows: DataFrame, key: list[str], sampled: Column) -> DataFrame | None:
    """(key, _times) of the sampled records with predictions that ``rows`` lists not at all or more than once; None if there are none.

    Keys are counted once per record before they are shuffled, not once per run.
    """
    asked = preds.where(sampled).select(*key).distinct()
    listed = rows.where(sampled).groupBy(*key).agg(F.count(F.lit(1)).alias("_times"))
    times = F.coalesce("_times", F.lit(0).cast("bigint"))
    odd = cut_lineage(asked.hint("merge").join(listed, key, "left").withColumn("_times", times).where("_times <> 1"))
    return None if odd.isEmpty() else odd


def _as_often(chosen: DataFrame, odd: DataFrame | None, key: list[str]) -> DataFrame:
    """Predictions as often as their record is listed, as a join with the list would give them."""
    if odd is None:
        return chosen
    each = chosen.join(small_table(odd), key, "left").withColumn("_times", F.coalesce("_times", F.lit(1).cast("bigint"))).where("_times > 0")
    return each.withColumn("_time", F.explode(F.sequence(F.lit(1).cast("bigint"), "_times"))).drop("_times", "_time")


def sample_sizes(sampled: DataFrame) -> DataFrame:
    """Members, non-members and fitting rows per run, counted on the rows that were really joined."""
    return sampled.groupBy(*RUN).agg(
        F.sum("member").cast("bigint").alias("n_members"), F.sum(1 - F.col("member")).cast("bigint").alias("n_non_members"),
        F.count_if(F.col("part") == "train").alias("n_attack_train"))


def attack_records(attacks: DataFrame, results: DataFrame) -> DataFrame:
    """Attack metrics joined with the target's test metrics by run_id."""
    target = results.where(F.col("split") == "test")
    delta = F.when(F.col("model_name") == "dp_sgd", F.lit(DEFAULTS.delta))
    kept = {"target_accuracy": "accuracy", "target_f1_macro": "f1_macro", "target_roc_auc": "roc_auc",
            "target_false_positive_rate": "false_positive_rate", "target_detection_rate": "detection_rate"}
    return attacks.join(target.select(
        "run_id", "dataset", "label_type", F.col("model_name").alias("target_model"), "epsilon",
        F.when(F.col("epsilon").isNotNull(), delta).alias("delta"),
        *[F.col(c).alias(n) for n, c in kept.items()]), RUN).withColumn(
        "attack_type", F.lit("black_box_confidence"))


def _todo(results: DataFrame, done: DataFrame, runs: DataFrame | None, force: bool) -> DataFrame:
    runs = results if runs is None else runs
    runs = runs.select("run_id", "dataset", "label_type", "model_name", "epsilon").distinct()
    if not force:
        runs = ledger.pending(runs, done, [
            ("dataset", "dataset"), ("label_type", "label_type"), ("model_name", "target_model"),
            ("epsilon", "epsilon")])
    return runs


def sweep(preds: DataFrame, rows: DataFrame, results: DataFrame, done: DataFrame, runs: DataFrame | None = None,
          force: bool = False, fit_rows: int = DEFAULTS.attack_cap, seed: int = DEFAULTS.seed) -> DataFrame:
    """Attack records of the runs not in ``done`` (all runs with ``force``).

    ``runs`` lists the runs (one row each, as training returns them); without it they are taken from ``results``.
    """
    todo = preds.join(small_table(_todo(results, done, runs, force).select("run_id")), "run_id", "left_semi")
    return attack_records(attack_runs(todo, rows, fit_rows, seed), results)


NO_ROWS, NO_RESULT = "no predictions of sampled rows", "no test results of the target"


def failures(runs: DataFrame, attackers: DataFrame, results: DataFrame) -> DataFrame:
    """(run_id, dataset, label_type, model_name, epsilon, problem) of the runs that have no attack record, with the reason."""
    tested = results.where("split = 'test'").select("run_id", F.lit(True).alias("_tested"))
    joined = runs.join(attackers.select("run_id", "problem", F.lit(True).alias("_fitted")), "run_id", "left").join(tested, "run_id", "left")
    reason = F.when(F.col("_fitted").isNull(), NO_ROWS).when(F.col("problem").isNotNull(), F.col("problem")).when(F.col("_tested").isNull(), NO_RESULT)
    return joined.withColumn("problem", reason).where("problem IS NOT NULL").select(*runs.columns, "problem")


def run_sweep(preds: DataFrame, rows: DataFrame, results: DataFrame, root: str, runs: DataFrame | None = None, force: bool = False,
              fit_rows: int = DEFAULTS.attack_cap, seed: int = DEFAULTS.seed) -> DataFrame:
    """Attack the runs that the store at ``root`` lacks, save their records there, and return the runs that failed with the reason."""
    done = ledger.load(preds.sparkSession, root, ATTACK_SCHEMA)
    todo = cut_lineage(_todo(results, done, runs, force))
    if todo.isEmpty():
        return todo.withColumn("problem", F.lit(None).cast("string"))
    metrics, attackers = _attacked(preds.join(small_table(todo.select("run_id")), "run_id", "left_semi"), rows, fit_rows, seed)
    ledger.save(attack_records(metrics, results), root, ATTACK_SCHEMA, ledger.ATTACK_KEY)
    return failures(todo, attackers, results)
