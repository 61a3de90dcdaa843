import hashlib
from collections import defaultdict

from sentinel.llm import line_dedup as d

BLANKS = " \t\n\x0b\x0c\r"
UP = {i: i + 32 for i in range(65, 91)}


def brute(rows):
    holders = defaultdict(set)
    key = lambda line: line.strip(BLANKS).translate(UP)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(key(x)) < 20 or len(holders[key(x)]) < 3 or i == max((h for h in holders[key(x)] if h is not None), default=None)]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return out


def shown(rows):
    return sorted(((i, n, m, hashlib.sha256((t or "").encode()).hexdigest()) for i, n, m, t in rows), key=str)


SHARED = "All rights reserved by the owner"
ODD = [
    (1, f"{SHARED}\nfirst\n  {SHARED.upper()}\t"), (2, f"second\n\n{SHARED}\r"), (3, f"{SHARED}\nthird\n"), (4, None), (5, ""), (6, "\n\n"),
    (7, "exactly twenty chars\nÄÖÜ ärger über öfen dreimal"), (8, "EXACTLY twenty chars\näÖÜ ärger über öfen dreimal"), (9, "exactly TWENTY chars\nÄÖÜ ärger über öfen dreimal"),
    (10, "nineteen characters"), (11, "nineteen characters"), (12, "nineteen characters"), (2, f"another text\n{SHARED}"), (2, f"another text\n{SHARED}"),
    (None, SHARED), (None, f"{SHARED}\nno id"), (13, "held twice but by one document only"), (13, "held twice but by one document only\nHELD twice but by one document only"),
    (14, " all rights reserved by the owner"), (15, "with no id in largest place\nx"), (None, "with no id in largest place"), (16, "with no id in largest place"),
    (17, "\U0001F600" * 20), (18, "\U0001F600" * 20), (19, "\U0001F600" * 20), (20, "\U0001F600" * 19), (21, "\U0001F600" * 19), (22, "\U0001F600" * 19),
]


def test_against_brute_force(documents, spark):
    rows = ODD + [(1000 + r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    out = [tuple(r) for r in d.report(documents(rows, extra=("_gone", "_pos", "n_lines", "_r1"))).collect()]
    assert shown(out) == shown(brute(rows))
    assert sum(r[2] for r in out) > 100


def test_other_columns_pass_through(documents):
    df = documents(ODD, extra=("_gone", "_doc", "_line", "_h1", "_keeper"))
    out = d.drop_common_lines(df)
    assert out.columns == df.columns and out.schema["text"].dataType == df.schema["text"].dataType
    want = sorted(((i, t if r[2] else raw) for (i, raw), r in zip(ODD, brute(ODD)) for t in (r[3],)), key=str)
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == want
    assert all(r["_gone"] == "x" and r["source"] == "src0" for r in out.collect())


def test_a_line_in_a_third_of_the_documents(documents):
    rows = [(i, (f"{SHARED}\n" if i % 3 == 0 else "") + f"line of document number {i}") for i in range(3000)]
    out = {r["doc_id"]: r for r in d.report(documents(rows)).collect()}
    assert all(out[i]["n_dropped"] == (i % 3 == 0 and i != 2997) for i, _ in rows)


def test_many_lines_in_one_text(documents):
    text = "\n".join([SHARED] * 50_000 + [f"line {i}" for i in range(50_000)])
    out = {r["doc_id"]: r for r in d.report(documents([(1, text), (2, text), (3, text)])).collect()}
    assert [out[i]["n_dropped"] for i in (1, 2, 3)] == [50_000, 50_000, 0] and out[1]["n_lines"] == 100_000
    assert out[1]["text"].startswith("line 0\nline 1\n")


def test_other_thresholds_and_empty_table(documents):
    rows = [(1, "short\nx"), (2, "short\ny")]
    assert {r["doc_id"]: r["text"] for r in d.report(documents(rows), 5, 2).collect()} == {1: "x", 2: "short\ny"}
    assert d.report(documents([])).count() == 0 and d.drop_common_lines(documents([])).count() == 0
