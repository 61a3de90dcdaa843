"""Streams whose files hold no new rows."""

import os

import pytest

from sentinel.streaming import ingest


def _write(root, number, *lines):
    folder = f"{root}/raw/cic_ids2018"
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/f{number}.csv", "w") as out:
        out.write("\n".join(("Flow Value,Label", *lines)) + "\n")
    os.utime(f"{folder}/f{number}.csv", (1e9 + number, 1e9 + number))


@pytest.mark.parametrize("files", [[(), ("1.5,Benign",)], [("1.5,Benign",), ("1.5,Benign",), ("2.5,Benign", "1.5,Benign")], [(), (), ("1.5,Benign",), ()], [()]])
def test_files_without_new_rows(spark, tmp_path, files):
    for number, lines in enumerate(files):
        _write(tmp_path, number, *lines)
    ingest.ingest_distinct(spark, f"{tmp_path}/raw", "cic_ids2018", f"{tmp_path}/out", f"{tmp_path}/state", files_per_batch=1)
    rows = [r["flow_value"] for r in ingest.read_ingested(spark, f"{tmp_path}/out").collect()]
    assert sorted(rows) == sorted({float(line.split(",")[0]) for lines in files for line in lines})
