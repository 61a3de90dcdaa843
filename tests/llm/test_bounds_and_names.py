"""Bounds of what is fitted on, vectors of several lengths, and columns whose names an operator uses itself."""

import pytest
from pyspark.sql import functions as F

from sentinel.llm import mixing, multi_index, quality_rules, secret_scan, subword, surrogates


def test_sample_bounds_rows_however_often_an_id_occurs(spark, documents):
    docs = documents([(1, f"text {i}") for i in range(500)] + [(2, "same")] * 300 + [(3, "other")])
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (2, 1)], "doc_id long, quality int")
    assert quality_rules.labelled_sample(docs, labels, "quality", 2).select("_key").distinct().count() <= 2
    everything = quality_rules.labelled_sample(docs, labels, "quality", 10_000).collect()
    assert len(everything) == 500 + 2 + 1 and sorted(r["_y"] for r in everything if r["doc_id"] == 2) == [0, 1]


def test_bags_of_long_texts_are_bounded(spark, documents, monkeypatch):
    monkeypatch.setattr(subword, "MAX_ENTRIES", 60)
    docs = documents([(i, " ".join(f"word{i}x{j}" for j in range(5))) for i in range(40)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    assert 0 <= subword.score(docs, subword.fit(docs, labels)).first()["score"] <= 1


@pytest.mark.parametrize("first", [0, 1])
def test_every_length_has_an_index(spark, first):
    rows = [(i, [float(i % 7 + 1), float(i % 11), 1.0, float(i)]) for i in range(300)] + [(1000 + i, [1.0, float(i + first), 2.0]) for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = multi_index.search(df, F.col("vec_id") % 50 == 0).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r["vec_id"])
    assert sorted(by) == [*range(0, 300, 50), 1000] and all(len(v) == 5 for q, v in by.items() if q < 300)
    assert all(i < 300 for q, v in by.items() if q < 300 for i in v) and sorted(by[1000]) == [1001, 1002, 1003]


CLASHES = ("_key", "_spans", "_new", "_text", "_doc", "_copies", "_number", "_", "key", "_same", "_all")


def test_columns_of_any_name_pass_through(documents):
    text = "Anna Schmidt has password=Zx9Qw8Er7Ty6Ui5Op4 and a@b.com"
    df = documents([(1, text, "en", "a"), (2, "plain", "en", "b"), (3, None, "en", "b")], extra=CLASHES)
    df = df.withColumn("tags", F.create_map(F.lit("k"), F.col("doc_id"))).withColumn("n_entities", F.lit(7))
    for out in (secret_scan.redact(df, F.col("source"), F.concat_ws("/", "source", "lang")), surrogates.replace(df, "k"), mixing.mixed(df)):
        assert sorted(out.columns) == sorted(df.columns)
        rows = out.collect()
        assert all(r[c] == "x" for r in rows for c in CLASHES) and all(r["tags"] == {"k": r["doc_id"]} for r in rows)
    assert {r["doc_id"] for r in secret_scan.redact(df, F.col("source"), F.col("lang")).collect()} == {1, 2, 3}


def CLASSES_OF(row):
    return [c for c in CLASHES if c in row]
