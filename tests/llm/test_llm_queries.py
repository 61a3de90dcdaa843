"""The registered queries: contracts on whole tables, SQL where there is some, and the pipeline stage by stage."""

import re
from collections import defaultdict

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from sentinel.llm import minhash, packing, queries
from workload.check import compare, connect

SF = "/root/testdata/sf0.01"
NAMES = sorted(queries.QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    df = entry.queries()[name](spark, SF)
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns)
    if name in queries.SQL:
        assert compare(rows, df.dtypes, connect(SF), queries.SQL[name]) is None


def test_all_operators_and_the_pipeline_are_registered():
    found = [re.match(r"op(\d+)_", n)[1] for n in entry.queries() if re.match(r"op(\d+)_", n)]
    assert sorted(map(int, found)) == list(range(1, 14)) and "pipeline" in entry.queries()


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, tables = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = tables[name] = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns
    quality = {r["doc_id"]: r["text"] for r in tables["quality_rules"].collect()}
    judged = {r["doc_id"]: r["kept"] for r in queries.op2_quality_rules(spark, SF).collect()}
    assert set(quality) == {i for i, kept in judged.items() if kept}
    groups = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(tables["quality_rules"], percent=80, bands=30).collect()}
    unique = {r["doc_id"]: r["text"] for r in tables["minhash_dedup"].collect()}
    assert set(unique) == set(groups.values()) and all(unique[i] == quality[i] for i in unique)
    clean = {r["doc_id"]: (r["text"], r["n_chars"]) for r in tables["secret_scans"].collect()}
    assert clean.keys() == unique.keys() and all(len(t) == n for t, n in clean.values())
    assert any("[SECRET]" in t for t, _ in clean.values())
    assert all(t == unique[i] or "[SECRET]" in t for i, (t, _) in clean.items())
    mixed = defaultdict(int)
    for r in tables["mixing"].collect():
        mixed[r["doc_id"]] += 1
        assert r["text"] == clean[r["doc_id"]][0]
    assert set(mixed.values()) <= {1, 2}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, (t, _) in clean.items()}
    assert sum(size[i] * n for i, n in mixed.items()) == pytest.approx(1.5 * sum(size.values()), rel=0.05)
    packed = defaultdict(int)
    for r in tables["packing"].collect():
        packed[r["doc_id"]] += r["length"]
        assert r["capacity"] in packing.CAPACITIES
    assert packed == {i: size[i] * n for i, n in mixed.items()}


def test_odd_rows_pass_all_stages(spark, documents, tmp_path):
    good = " ".join(f"word{i}" for i in range(80)) + "."
    rows = [(1, None), (2, ""), (3, good), (3, good), (None, good), (4, good + " password=Zx9Qw8Er7Ty6Ui5Op4", None, None), (5, "w " * 20_000)]
    for table in (documents(rows, extra=("kept", "score", "copy", "spans", "_n")), documents([])):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            path = f"{tmp_path}/{name}-{len(table.columns)}"
            out.write.parquet(path)
            assert name == "packing" or out.columns == table.columns
            docs = spark.read.parquet(path)
