"""Lots of the private network that are large enough for several cores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentinel.operators import accountant, dp_mlp


def test_a_large_lot_is_read_by_several_tasks(spark, tmp_path):
    n, rate = 12_000, 0.5
    slim = spark.range(n).select(F.col("id").alias("k"), F.array(F.col("id").cast("double")).alias("x"), F.lit(0).alias("y"))
    stored = dp_mlp._stored_lots(slim, rate, 1, 3, "s", n, str(tmp_path / "large"))
    want = {(r["step"], r["k"]) for r in dp_mlp.assign_lots(slim, "k", rate, 1, 3, "s").select("step", "k").collect()}
    got = [(r["step"], r["k"]) for r in stored.select("step", "k").collect()]
    assert len(got) == len(want) and set(got) == want
    for step in (1, 2, 3):
        counts = stored.where(F.col("step") == step).groupBy(F.input_file_name()).count().collect()
        assert len(counts) == 6 and max(r["count"] for r in counts) <= 1200
        assert stored.where(F.col("step") == step).rdd.getNumPartitions() >= 4
    small = dp_mlp._stored_lots(slim.where("k < 900"), rate, 1, 3, "s", 900, str(tmp_path / "small"))
    assert small.where("step = 1").select(F.input_file_name()).distinct().count() == 1


def test_gradients_of_a_large_batch_are_added_in_parts(monkeypatch):
    rng = np.random.default_rng(5)
    shapes = ((4, 8), (8, 3))
    theta = dp_mlp.initial_weights(shapes, rng)
    x, y, weight = rng.normal(size=(70, 4)), rng.integers(0, 3, 70), rng.random(70) + 0.5
    whole, loss = dp_mlp.clipped_gradient(x, y, weight, theta, shapes, 0.7)
    each = [dp_mlp.clipped_gradient(x[[i]], y[[i]], weight[[i]], theta, shapes, 0.7) for i in range(70)]
    calls, real = [], dp_mlp._add_clipped
    monkeypatch.setattr(dp_mlp, "GRADIENT_ROWS", 16)
    monkeypatch.setattr(dp_mlp, "_add_clipped", lambda x, *a: calls.append(len(x)) or real(x, *a))
    parts, loss_of_parts = dp_mlp.clipped_gradient(x, y, weight, theta, shapes, 0.7)
    assert calls == [16, 16, 16, 16, 6]
    np.testing.assert_allclose(parts, whole, atol=1e-12)
    np.testing.assert_allclose(whole, sum(g for g, _ in each), atol=1e-12)
    assert loss == pytest.approx(loss_of_parts) == pytest.approx(sum(v for _, v in each))


def test_terms_of_the_accountant_are_spread(spark):
    few = spark.createDataFrame([(0.01, 1.0), (0.02, 1.5)], "rate double, sigma double")
    assert accountant.rdp(few).rdd.getNumPartitions() > 1
