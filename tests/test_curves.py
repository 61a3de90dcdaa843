"""ROC curves by packed scores against plain loops, with lists, ranges and groups made small."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sentinel.operators import attack, curves
from sentinel.operators import metrics as M
from sentinel.operators.ranking import roc_auc, roc_auc_ovr

KEYS = ["run_id"]


def _scores(kind, n=3000):
    draw = random.Random(kind)
    value = {"wide": draw.random, "ties": lambda: draw.randrange(5) / 4, "band": lambda: 1.0 - draw.randrange(4000) * 1e-16,
             "hot": lambda: 0.25 if draw.random() < 0.9 else draw.random(), "nan": lambda: draw.choice([math.nan, draw.random(), -0.0, 0.0, math.inf])}[kind]
    return [(kind if kind != "ties" else None, value(), int(draw.random() < 0.3)) for _ in range(n)]


def _order(s):
    return (1, 0.0) if math.isnan(s) else (0, s)


def _area(rows):
    at = {}
    for _, s, y in rows:
        at.setdefault(_order(s), [0, 0])[y] += 1
    below = pairs = 0
    for k in sorted(at):
        pairs += at[k][1] * (below + at[k][0] / 2)
        below += at[k][0]
    return pairs / (below * (len(rows) - below))


def _tpr(rows, limit):
    p, n, best, got = sum(y for *_, y in rows), sum(1 - y for *_, y in rows), 0.0, [0, 0]
    rows = sorted(rows, key=lambda r: _order(r[1]), reverse=True)
    for i, (_, s, y) in enumerate(rows):
        got[y] += 1
        if (i + 1 == len(rows) or _order(rows[i + 1][1]) != _order(s)) and got[0] / n <= limit:
            best = max(best, got[1] / p)
    return best


@pytest.fixture
def small(monkeypatch):
    for name, value in (("BUFFER", 500), ("CHUNK", 16), ("BLOCK", 200), ("BINS", 3)):
        monkeypatch.setattr(curves, name, value)


KINDS = "wide", "ties", "band", "hot", "nan"


@pytest.mark.parametrize("size", [3000, 150])
def test_areas_and_rates_over_many_ranges(spark, small, size):
    rows = [r for k in KINDS for r in _scores(k, size)]
    df = spark.createDataFrame(rows, "run_id string, score double, member int").repartition(5)
    limits = {"a": 0.0, "b": 0.01, "c": 0.1, "d": 0.95, "e": 1.0}
    area = {r["run_id"]: r["roc_auc"] for r in roc_auc(df, KEYS, "score", F.col("member") == 1).collect()}
    rates = {r["run_id"]: r for r in attack.tpr_at_fpr(df, KEYS, limits).collect()}
    for kind in KINDS:
        run = kind if kind != "ties" else None
        own = [r for r in rows if r[0] == run]
        assert area[run] == pytest.approx(_area(own), abs=1e-12)
        assert [rates[run][n] for n in limits] == pytest.approx([_tpr(own, v) for v in limits.values()])


def test_missing_scores_are_below_all_others_in_the_curve_and_no_part_of_the_area(spark, small):
    rows = [("r", 0.9, 1), ("r", 0.5, 0), ("r", None, 1), ("r", None, 0), ("s", None, 1)]
    df = spark.createDataFrame(rows, "run_id string, score double, member int").withColumn("y_pred", F.lit(1))
    got = {r["run_id"]: r for r in attack.tpr_at_fpr(df, KEYS, {"none": 0.0, "half": 0.5, "all": 1.0}).collect()}
    assert [got["r"][c] for c in ("none", "half", "all")] == [0.5, 0.5, 1.0] and got["s"]["all"] == 1.0
    assert {r["run_id"]: r["attack_roc_auc"] for r in attack.attack_metrics(df, KEYS).collect()} == {"r": 1.0, "s": None}


def test_one_vs_rest_over_many_ranges(spark, small):
    draw = random.Random(5)
    rows = [(draw.randrange(2), draw.randrange(3), draw.randrange(3), [round(draw.random(), 3) for _ in range(3)]) for _ in range(4000)]
    rows += [(0, 1, 1, None), (1, 2, 0, None)]
    df = spark.createDataFrame(rows, "run_id int, y_true int, y_pred int, probs array<double>").repartition(4)
    suite = {r["run_id"]: r for r in M.evaluate(df, KEYS, "multiclass").collect()}
    ovr = {r["run_id"]: r["roc_auc"] for r in roc_auc_ovr(df, KEYS, "probs", "y_true").collect()}
    for run in (0, 1):
        own = [r for r in rows if r[0] == run]
        mean = sum(_area([(0, p[c], int(y == c)) for _, y, _, p in own if p]) for c in range(3)) / 3
        assert suite[run]["roc_auc"] == pytest.approx(mean, abs=1e-12) and ovr[run] == pytest.approx(mean, abs=1e-12)
        assert suite[run]["accuracy"] == pytest.approx(sum(y == p for _, y, p, _ in own) / len(own))


def test_scores_are_packed_before_they_are_shuffled(spark):
    """A list of thousands of scores moves as one row; no plan holds a row per score after the scan."""
    df = spark.range(200_000).select(F.lit("r").alias("run_id"), F.rand(1).alias("score"), (F.col("id") % 2).cast("int").alias("member")).coalesce(2)
    packed = curves.pack_scores(df, KEYS, F.col("member"), F.array("score"), first_class=1)
    sizes = packed.select(F.size("at").alias("n")).agg(F.sum("n").alias("all"), F.count("n").alias("rows")).first()
    assert sizes["all"] == 200_000 and sizes["rows"] < 100
