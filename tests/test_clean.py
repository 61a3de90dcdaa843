"""Labels, cleaning, raw files and the two build stages."""

import os

import pytest
from pyspark.sql import functions as F

from sentinel.functions.cols import normalize_columns, normalize_name
from sentinel.operators import clean, labels
from sentinel.plans import preprocess
from sentinel.schema import CIC_LABELS, UNSW_COLUMNS, UNSW_LABELS, Settings
from sentinel.sources import raw, tables
from sentinel.streaming import ingest


def test_names():
    assert normalize_name(" Flow Duration") == "flow_duration"
    assert normalize_name("Flow Byts/s") == "flow_byts_s"
    assert normalize_name("__A  (b)__") == "a_b"


def test_colliding_names(spark):
    with pytest.raises(ValueError):
        normalize_columns(spark.createDataFrame([(1, 2)], ["a b", "A_b"]))


def test_cic_labels(spark):
    texts = [*CIC_LABELS, " BENIGN ", "DoS attacks-Hulk", "never seen", None]
    got = {r["label_raw"]: r for r in labels.map_cic_labels(
        spark.createDataFrame([(t,) for t in texts], "label string")).collect()}
    for text, cls in CIC_LABELS.items():
        assert got[text]["label_multiclass"] == cls and got[text]["label_binary"] == (cls != "BENIGN")
    assert got["BENIGN"]["label_binary"] == 0
    assert got["DoS attacks-Hulk"]["label_multiclass"] == "DoS"
    assert got["never seen"]["label_multiclass"] == "Unknown" and got["never seen"]["label_binary"] == 1
    assert got["nan"]["label_multiclass"] == "Unknown"
    with pytest.raises(KeyError):
        labels.map_cic_labels(spark.range(1), "label")


def test_unsw_labels(spark):
    rows = [("", 0), (" DoS", 1), ("Backdoors", 1), (None, 0), ("odd", 0)]
    got = labels.map_unsw_labels(spark.createDataFrame(rows, "attack_cat string, label int")).collect()
    assert [(r["label_multiclass"], r["label_binary"]) for r in got] == [
        ("BENIGN", 0), ("DoS", 1), ("Malware", 1), ("BENIGN", 0), ("Unknown", 0)]
    assert set(UNSW_LABELS.values()) >= {"Fuzzing", "Other", "Exploits"}


def test_encoder_is_alphabetical_and_strict(spark):
    train = spark.createDataFrame([("DoS",), ("BENIGN",), ("DDoS",)], "label_multiclass string")
    encoder = labels.fit_encoder(train)
    assert {r[0]: r["code"] for r in encoder.collect()} == {"BENIGN": 0, "DDoS": 1, "DoS": 2}
    other = spark.createDataFrame([("Worm",)], "label_multiclass string")
    with pytest.raises(Exception, match="unseen label"):
        labels.encode(other, encoder).collect()


def test_impute_and_drop(spark):
    df = spark.createDataFrame(
        [(1.0, None, "x"), (3.0, None, "y"), (None, None, "y"), (10.0, 1.0, None), (None, None, "x")],
        "a float, b float, c string")
    kept, dropped = clean.drop_sparse_columns(df, 0.6)
    assert dropped == ["b"]
    assert clean.drop_sparse_columns(df, 0.8)[1] == []  # exactly at the threshold stays
    full = clean.impute(kept)
    assert sorted(r["a"] for r in full.collect()) == [1.0, 3.0, 3.0, 3.0, 10.0]
    assert sorted(r["c"] for r in full.collect()) == ["x", "x", "x", "y", "y"]  # tie goes to the smaller


def test_coerce(spark):
    df = spark.createDataFrame([("1.5", "1"), ("inf", "2"), ("nan", "3"), ("59.166.0.0", "4"), ("0x1f", "5"), (None, "6"),
                                (" 7 ", "7")], "v string, label_raw string")
    out = clean.coerce_features(df)
    assert [r["v"] for r in out.orderBy("label_raw").collect()] == [1.5, None, None, None, None, None, 7.0]
    assert dict(out.dtypes) == {"v": "float", "label_raw": "string"}


def write_cic(folder, rows, name="a.csv"):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w", encoding="latin-1") as fh:
        fh.write(" Flow Duration,Flow Byts/s,Note, Label\n" + "\n".join(rows) + "\n")


def test_raw_scan_pads_short_and_skips_long_rows(spark, tmp_path):
    write_cic(f"{tmp_path}/cic_ids2018", ["1,2.5,é,Benign", "2,3.5", "3,4,n,Bot,extra", '4,5,"a,b,c,d",Bot'])
    rows = raw.read_raw(spark, str(tmp_path), "cic_ids2018").orderBy("flow_duration").collect()
    assert [(r["flow_duration"], r["note"], r["label"]) for r in rows] == [
        ("1", "é", "Benign"), ("2", None, None), ("4", "a,b,c,d", "Bot")]
    assert raw.count_malformed(spark, str(tmp_path), "cic_ids2018").first()["n_malformed"] == 1


def test_raw_scan_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        raw.read_raw(spark, str(tmp_path), "cic_ids2018")
    os.makedirs(f"{tmp_path}/unsw_nb15")
    with pytest.raises(FileNotFoundError):
        raw.read_raw(spark, str(tmp_path), "unsw_nb15")
    with pytest.raises(ValueError):
        raw.read_raw(spark, str(tmp_path), "other")


def test_headerless_files_have_49_columns(spark, tmp_path):
    os.makedirs(f"{tmp_path}/unsw_nb15")
    row = ["59.166.0.0", "33", *["1"] * 45, "", "0"]
    with open(f"{tmp_path}/unsw_nb15/u1.csv", "w") as fh:
        fh.write(",".join(row) + "\n")
    df = raw.read_raw(spark, str(tmp_path), "unsw_nb15")
    assert len(df.columns) == len(UNSW_COLUMNS) == 49
    out = preprocess.clean_rows(df, "unsw_nb15").first()
    assert out["srcip"] is None and out["sport"] == 33.0 and out["label_multiclass"] == "BENIGN"


def test_stages_end_to_end_and_idempotent(spark, tmp_path):
    names = ["Benign", "DoS attacks-Hulk", "Bot"]
    rows = [f"{i},{'inf' if i % 10 == 0 else i / 2},10.0.0.1,{names[i % 3]}" for i in range(300)]
    write_cic(f"{tmp_path}/raw/cic_ids2018", rows + rows[:50])
    out = f"{tmp_path}/out"
    assert preprocess.run_preprocessing(spark, f"{tmp_path}/raw", out, "cic_ids2018")
    assert not preprocess.run_preprocessing(spark, f"{tmp_path}/raw", out, "cic_ids2018")
    done = tables.read_table(spark, f"{out}/processed/cic_ids2018")
    assert done.count() == 300 and "note" not in done.columns
    assert done.where("flow_byts_s IS NULL").count() == 0
    dropped = spark.read.parquet(f"{out}/dropped_columns/cic_ids2018").collect()
    assert [(r["dataset"], r["column"]) for r in dropped] == [("cic_ids2018", "note")]
    assert preprocess.run_sampling(spark, out, "cic_ids2018", Settings(subset_size=150))
    subset = tables.read_table(spark, f"{out}/subsets/cic_ids2018")
    counts = {(r["label_multiclass"], r["split"]): r["count"]
              for r in subset.groupBy("label_multiclass", "split").count().collect()}
    assert set(counts.values()) == {30, 10} and sum(counts.values()) == 150
    with pytest.raises(ValueError):
        tables.write_subset(subset.drop("split"), f"{out}/x")


def write_csv(folder, name, header, rows):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w", encoding="latin-1") as fh:
        fh.write("\n".join([header, *rows]) + "\n")


def test_files_are_aligned_by_their_own_headers(spark, tmp_path):
    folder = f"{tmp_path}/cic_ids2018"
    write_csv(folder, "a.csv", "Dst Port,Flow Duration,Label", ["80,1.5,Benign", "81", "82,1,Bot,long"])
    write_csv(folder, "b.csv", "Flow ID,Src IP,Dst Port,Flow Duration,Label", ["x,10.0.0.1,443,2.5,Bot", "y,10.0.0.2,444,3.5,Bot,long"])
    write_csv(folder, "c.csv", "Flow Duration, Dst  Port ,Label", ['9.5,8080,"Benign"'])
    rows = raw.read_raw(spark, str(tmp_path), "cic_ids2018").orderBy("dst_port").collect()
    assert raw.read_raw(spark, str(tmp_path), "cic_ids2018").count() == 4
    assert [(r["dst_port"], r["flow_duration"], r["label"], r["src_ip"]) for r in rows] == [
        ("443", "2.5", "Bot", "10.0.0.1"), ("80", "1.5", "Benign", None), ("8080", "9.5", "Benign", None), ("81", None, None, None)]
    bad = {r["file"]: (r["n_malformed"], r["n_filled"]) for r in raw.count_malformed(spark, str(tmp_path), "cic_ids2018").collect()}
    assert bad == {"a.csv": (1, 3), "b.csv": (1, 2), "c.csv": (0, 1)}
    write_csv(folder, "d.csv", "Dst Port,dst_port", ["1,2"])
    with pytest.raises(ValueError):
        raw.read_raw(spark, str(tmp_path), "cic_ids2018")


def test_stream_equals_batch(spark, tmp_path):
    for i in range(3):
        write_cic(f"{tmp_path}/cic_ids2018", [f"{i}{j},{j},n,Benign" for j in range(5)], f"f{i}.csv")
    ingest.ingest_available(spark, str(tmp_path), "cic_ids2018", f"{tmp_path}/o", f"{tmp_path}/s", files_per_batch=1)
    batch = preprocess.clean_rows(raw.read_raw(spark, str(tmp_path), "cic_ids2018"), "cic_ids2018")
    got = ingest.read_ingested(spark, f"{tmp_path}/o").select(*batch.columns)
    assert got.exceptAll(batch).count() == 0 and batch.exceptAll(got).count() == 0
    write_csv(f"{tmp_path}/cic_ids2018", "late.csv", "Label,Flow Duration,Src Port", ["Bot,99,5"])
    ingest.ingest_available(spark, str(tmp_path), "cic_ids2018", f"{tmp_path}/o", f"{tmp_path}/s")
    got = ingest.read_ingested(spark, f"{tmp_path}/o")
    assert got.count() == 16
    late = got.where("src_port IS NOT NULL").first()
    assert (late["flow_duration"], late["label_multiclass"], late["flow_byts_s"]) == (99.0, "Botnet", None)


def test_stream_drops_recent_duplicates(spark, tmp_path):
    schema = "k int, at timestamp"
    day = "2024-01-01 00:0"
    for i, rows in enumerate([[(1, f"{day}1:00"), (1, f"{day}1:30"), (2, f"{day}2:00")], [(1, f"{day}2:30"), (3, f"{day}3:00")]]):
        spark.createDataFrame(rows, "k int, at string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode(
            "append").parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    out = ingest.drop_recent_duplicates(rows, ["k"], "at", "10 minutes")
    ingest.run_available(out, f"{tmp_path}/out", f"{tmp_path}/state")
    assert sorted(r["k"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2, 3]


def test_csv_export(spark, tmp_path):
    tables.export_csv(spark.createDataFrame([("ε", 1.5)], "name string, v double"), f"{tmp_path}/r")
    part = [f for f in os.listdir(f"{tmp_path}/r") if f.endswith(".csv")]
    assert len(part) == 1
    assert open(f"{tmp_path}/r/{part[0]}", encoding="utf-8").read() == "name,v\nε,1.5\n"


def test_quoted_fields_like_a_csv_reader(spark, tmp_path):
    import csv

    texts = ["plain", 'say ""hi"", ok', "two\nlines", "a,b", "", '""', 'ends with ""', "three\n\n,lines \"\"\n", "back\\slash", "back\\\\", "ü, é", '5" disk', " padded "]
    folder = f"{tmp_path}/cic_ids2018"
    os.makedirs(folder)
    for name, some in (("with breaks.csv", texts), ("lines.csv", [t for t in texts if "\n" not in t])):
        with open(f"{folder}/{name}", "w", encoding="latin-1", newline="") as fh:
            fh.write("Flow Value,Note,Label\n")
            for i, t in enumerate(some):
                note = t if '5"' in t else f'"{t}"'
                fh.write(f"{i}.5,{note},Benign\n")
            fh.write('99,"x\ny",Bot,more,"and, more"\n' if "breaks" in name else '99,"x,y",Bot,more\n')
            fh.write("98\n")
    want = []
    for name in ("lines.csv", "with breaks.csv"):
        with open(f"{folder}/{name}", encoding="latin-1", newline="") as fh:
            rows = list(csv.reader(fh))[1:]
        want += [[v or None for v in [*r, None, None][:3]] for r in rows if len(r) <= 3]
    got = [[r["flow_value"], r["note"] or None, r["label"]] for r in raw.read_raw(spark, str(tmp_path), "cic_ids2018").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) == 2 * len(texts) - 2 + 2
    assert {r["file"].replace("%20", " "): r["n_malformed"] for r in raw.count_malformed(spark, str(tmp_path), "cic_ids2018").collect()} == {"with breaks.csv": 1, "lines.csv": 1}
    ingest.ingest_available(spark, str(tmp_path), "cic_ids2018", f"{tmp_path}/out", f"{tmp_path}/state")
    assert ingest.read_ingested(spark, f"{tmp_path}/out").count() == len(want)
    spanning = raw.files_with_spanning_records(spark, raw.list_raw_files(spark, str(tmp_path), "cic_ids2018"), raw.DIALECTS["cic_ids2018"])
    assert [f.rsplit("/", 1)[1] for f in spanning] == ["with breaks.csv"]


def test_stages_follow_their_inputs_and_settings(spark, tmp_path):
    write_cic(f"{tmp_path}/raw/cic_ids2018", [f"{i},{i},n,Benign" for i in range(60)])
    raw_dir, out = f"{tmp_path}/raw", f"{tmp_path}/out"
    stages = lambda **k: (preprocess.run_preprocessing(spark, raw_dir, out, "cic_ids2018"), preprocess.run_sampling(spark, out, "cic_ids2018", Settings(**k)))
    assert stages() == (True, True) and stages() == (False, False) and stages(seed=7) == (False, True)
    write_cic(f"{tmp_path}/raw/cic_ids2018", [f"{i},{i},n,Bot" for i in range(60, 90)], "b.csv")
    assert stages(seed=7) == (True, True) and stages(seed=7) == (False, False)
    assert tables.read_table(spark, f"{out}/subsets/cic_ids2018").count() == 90
    assert tables.published(spark, f"{out}/processed/cic_ids2018")["dropped"] == ["note"]


def test_stream_without_duplicates_equals_the_batch(spark, tmp_path):
    import shutil

    folder = f"{tmp_path}/cic_ids2018"
    for i in range(4):
        write_csv(folder, f"f{i}.csv", "Flow Duration,Src Port,Label", [f"{j % 7}.5,{j % 3},Benign" for j in range(i, 40)] + ["0.0,1,Bot", "-0.0,1,Bot", ",,Bot"])
    write_csv(folder, "g.csv", "Label,Flow Duration", ["Bot,", "Benign,77", "Bot,0.0"])
    out, state = f"{tmp_path}/out", f"{tmp_path}/state"
    ingest.ingest_distinct(spark, str(tmp_path), "cic_ids2018", out, state, files_per_batch=2)
    columns = ["flow_duration", "src_port", "label_raw", "label_multiclass", "label_binary", "dataset_source"]
    batch = clean.drop_duplicates(preprocess.clean_rows(raw.read_raw(spark, str(tmp_path), "cic_ids2018"), "cic_ids2018")).select(columns)
    got = lambda: sorted(map(str, ingest.read_ingested(spark, out).select(columns).collect()))
    want = sorted(str(r).replace("=-0.0", "=0.0") for r in batch.collect())
    assert [r.replace("=-0.0", "=0.0") for r in got()] == want
    # a batch that is repeated after a failure: its offsets are there, its commit is not
    last = sorted(os.listdir(f"{state}/commits"), key=lambda n: (n.startswith("."), n))
    for name in [n for n in os.listdir(f"{state}/commits") if n.strip(".").split(".")[0] == max(x for x in last if x.isdigit())]:
        os.remove(f"{state}/commits/{name}")
    shutil.rmtree(f"{out}_keys/batch={max(int(n[6:]) for n in os.listdir(out + '_keys') if n.startswith('batch='))}")
    ingest.ingest_distinct(spark, str(tmp_path), "cic_ids2018", out, state, files_per_batch=2)
    assert [r.replace("=-0.0", "=0.0") for r in got()] == want
    write_csv(folder, "late.csv", "Src Port,Flow Duration,Label", ["1,1.5,Benign", "9,9,Bot", "9,9,Bot"])
    ingest.ingest_distinct(spark, str(tmp_path), "cic_ids2018", out, state, files_per_batch=2)
    assert len(got()) == len(want) + 1
