import re
from collections import Counter

import numpy as np
import pyarrow as pa

from sentinel.llm import quality_rules as q

ODD = ["", "   ", "a", "a b c", "x y z x y z", "a\n\nb c\n a \nb c\nb c", "ü ß é wide space", "##$$ | <b> & 50%", "a a a a a a a",
       "line\nline\n\n  \nline.", "\n\n", "A B\tC\x0bD\x0cE\rF", "one two three four " * 30, "last\nlast", "a\r\nb\r\na\r\n"]


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def test_statistics_against_brute_force(spark):
    texts = [*ODD, None] + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    base, matrix = q.statistics(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert {k: int(v[i]) for k, v in base.items()} == brute(text), text
    assert matrix.shape == (len(texts), len(q.FEATURES)) and np.isfinite(matrix).all()


def test_trees_are_monotone_and_learn():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 3))
    y = ((x[:, 0] < 0.6) & (x[:, 1] > 0.3)).astype(float)
    noisy = np.where(rng.random(2000) < 0.1, 1 - y, y)
    trees = q.fit_trees(x, noisy, np.array([-1, 0, -1]))
    assert ((trees.score(x) > 0.5) == y).mean() > 0.95
    for j in (0, 2):
        at = np.repeat(rng.random((50, 3)), 40, axis=0)
        at[:, j] = np.tile(np.linspace(0, 1, 40), 50)
        assert (np.diff(trees.score(at).reshape(50, 40), axis=1) <= 1e-12).all()


def test_flat_scoring_equals_walking():
    rng = np.random.default_rng(2)
    x, y = rng.random((300, 4)), (rng.random(300) < 0.4).astype(float)
    t = q.fit_trees(x, y, np.zeros(4), rounds=5)

    def walk(row):
        total = t.start
        for node in t.roots:
            while t.left[node] != node:
                node = t.left[node] if row[t.feature[node]] <= t.threshold[node] else t.right[node]
            total += t.value[node]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(t.score(x), [walk(r) for r in x])


def test_one_class_and_no_labels():
    assert np.allclose(q.fit_trees(np.ones((5, 2)), np.ones(5), np.zeros(2)).score(np.zeros((2, 2))), 1 - 1e-3)
    assert np.allclose(q.fit_trees(np.zeros((0, 2)), np.zeros(0), np.zeros(2)).score(np.zeros((2, 2))), 0.5)


def test_judge_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    trees = q.fit(docs, labels)
    out = {r["doc_id"]: r for r in q.judge(docs, trees).collect()}
    for r in docs.collect():
        want, got = brute(r["text"]), out[r["doc_id"]]
        assert all(got[k] == v for k, v in want.items())
        assert got["base_failed"] == (want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"])
        assert not (got["kept"] and got["base_failed"])
    hits = [out[r["doc_id"]]["score"] >= 0.5 for r in labels.collect()]
    truth = [r["quality"] == 1 for r in labels.collect()]
    assert np.mean(np.array(hits) == truth) > 0.95
    kept = q.keep(docs, trees)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in out.items() if r["kept"]}


def test_odd_rows(documents, spark):
    df = documents([(i, t) for i, t in enumerate(ODD)] + [(99, None), (None, "a"), (0, ODD[0])], extra=("kept", "score", "n_words"))
    labels = spark.createDataFrame([(0, None), (None, 1), (1, 1), (1, 0)], "doc_id long, quality int")
    trees = q.fit(df, labels)
    assert q.judge(df, trees).count() == len(ODD) + 3
    assert q.keep(df, trees).columns == df.columns
    assert q.judge(documents([]), q.fit(documents([]), labels)).count() == 0


def test_long_text(documents):
    text = "word" * 50 + " " + " ".join(f"w{i}" for i in range(300_000))
    base, _ = q.statistics(pa.array([text, "a b"]))
    assert base["n_words"].tolist() == [300_001, 2] and base["n_repeat_words"].tolist() == [0, 0]
