"""Credentials that are neither live nor copied examples are redacted, too."""

from pyspark.sql import functions as F

from sentinel.llm import secret_scan as s


def test_base_spans_that_are_no_example_are_hidden(documents):
    copied, reused, digits = "Qr4Tz6Lm2Nb9Vc3Xw1", "Zx9Qw8Er7Ty6Ui5Op4", "9f8e2d6c5b1234f7e8d9c6b5a2f3e7d8c9b6a5f4"
    rows = [(i, f"so password={copied} it is", "en", f"src{i}") for i in range(3)]
    rows += [(10 + i, f"so password={reused} it is", "en", f"src{i}") for i in range(2)] + [(20, f"key {digits} end", "en", "src0")]
    df = documents(rows)
    args = F.col("source"), F.concat_ws("/", "source", "lang")
    assert {r["doc_id"]: (r["n_live"], r["n_example"]) for r in s.report(df, *args).collect()} == {
        **{i: (0, 1) for i in range(3)}, 10: (0, 0), 11: (0, 0), 20: (0, 0)}
    out = {r["doc_id"]: r["text"] for r in s.redact(df, *args).collect()}
    assert out == {**{i: rows[i][1] for i in range(3)}, 10: "so [SECRET] it is", 11: "so [SECRET] it is", 20: "key [SECRET] end"}
