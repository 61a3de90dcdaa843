import numpy as np
import pytest
from pyspark.sql import functions as F

from sentinel.operators import sketches


def test_merged_batches_answer_like_one_table(spark, tmp_path):
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.normal(size=20_000), np.full(10_000, 3.0), rng.exponential(size=5_000) * 100])
    df = spark.createDataFrame([(i, float(v) if i % 50 else None, 1.0) for i, v in enumerate(values)], "i long, a double, b double")
    for batch in range(5):
        sketches.add_batch(df.where(F.col("i") % 5 == batch), ["a", "b"], f"{tmp_path}/s", batch)
    sketches.add_batch(df.where(F.col("i") % 5 == 4), ["a", "b"], f"{tmp_path}/s", 4)  # repeated
    found = sketches.quantiles(sketches.merged(spark, f"{tmp_path}/s"), [0.0, 0.1, 0.5, 0.9, 1.0])
    out = sketches.rank_error(df, ["a", "b"], found).collect()
    assert len(out) == 10 and all(r["rank_error"] < 0.02 for r in out)
    assert {r["n"] for r in found.where("feature = 'a'").collect()} == {34_300} and all(r["quantile"] == 1.0 for r in out if r["feature"] == "b")
    with pytest.raises(FileNotFoundError):
        sketches.merged(spark, f"{tmp_path}/none")
