"""The neighbour search where distances prune nothing: what it stores, and exact ties."""

import numpy as np
import pytest

from sentinel.operators import smote


@pytest.mark.parametrize("chunk, most", [(None, 6), (300, 40)])
def test_stored_rows_are_bounded_where_distances_prune_nothing(spark, monkeypatch, chunk, most):
    """Random directions, each twice: one pass without copies, or a copy for each chunk_rows rows; equal distances go by id."""
    half = np.random.default_rng(3).normal(size=(500, 24))
    x = np.concatenate([half, half[::-1]])
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, [float(v) for v in r], 0) for i, r in enumerate(x)], "id long, x array<double>, y int")
    stored, cut = [], smote.cut_lineage

    def counted(table):
        out = cut(table)
        stored.append(out.count())
        return out

    monkeypatch.setattr(smote, "cut_lineage", counted)
    more = {} if chunk is None else {"chunk_rows": chunk}
    got = {(r["id"], r["rank"]): r["neighbor"] for r in smote.nearest_neighbors(df, "id", "x", "y", 3, **more).collect()}
    assert sum(stored) <= most * len(x)
    for i in range(0, len(x), 7):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        assert [got[i, r] for r in (1, 2, 3)] == [int(j) for _, j in sorted(zip(d, range(len(x))))[:3]]


def test_new_rows_do_not_search_twice(spark):
    """The neighbours are stored; their two uses do not plan the search again, and values of type float give doubles."""
    df = spark.createDataFrame([(i, [float(i), float(i % 7)], int(i < 20)) for i in range(60)], "id long, x array<float>, y int")
    out = smote.smote(df, "id", "x", "y")
    assert "InArrow" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.schema["x"].dataType.simpleString() == "array<double>" and out.count() == 20
