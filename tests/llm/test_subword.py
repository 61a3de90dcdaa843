import zlib

import numpy as np
import pyarrow as pa

from sentinel.llm import subword as s


def test_grams_stay_inside_words():
    ids, owner = s.subwords(pa.array(["ab", "été", "x"]), 1 << 17)
    # <ab>: word, 2 grams of 3, 1 of 4; <été>: word, 3, 2, 1; <x>: word, 1
    assert np.bincount(owner).tolist() == [4, 7, 2]
    alone = s.subwords(pa.array(["été"]), 1 << 17)[0]
    assert sorted(ids[owner == 1].tolist()) == sorted(alone.tolist()) and (ids > 0).all()


def test_folded_score_equals_softmax_of_the_mean():
    texts = pa.array(["good words here here", "", None, "Ünïcode  a\tb"])
    rng = np.random.default_rng(1)
    model = s.Subword(rng.normal(size=1 << 12), 0.3)
    got = model.score(texts)
    for i, (ids, counts) in enumerate(s.bags(texts, 1 << 12)):
        mean = (model.weight[ids] * counts).sum() / (counts.sum() + s.PRIOR)
        assert abs(got[i] - 1 / (1 + np.exp(-(0.3 + mean)))) < 1e-12
    assert got[1] == got[2]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = s.fit(docs, labels, max_rows=2000)
    rows = s.score(docs, model).join(labels, "doc_id").toPandas()
    assert (rows["held_out"] == rows["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    held = rows[rows["held_out"]]
    assert ((held["predicted"] == 1) == (held["quality"] == 1)).mean() > 0.97
    bad, good = held[held["quality"] == 0]["score"].to_numpy(), held[held["quality"] == 1]["score"].to_numpy()
    assert (bad[:, None] < good[None, :]).mean() > 0.98
    assert ((rows["score"] >= 0) & (rows["score"] <= 1)).all() and ((rows["score"] >= 0.3) == (rows["predicted"] == 1)).all()


def test_odd_rows(documents, spark):
    df = documents([(1, None), (2, ""), (2, ""), (None, "a b"), (3, "word " * 50_000)], extra=("score", "held_out", "_y"))
    labels = spark.createDataFrame([(1, None), (None, 1), (3, 1), (2, 0), (2, 0)], "doc_id long, quality int")
    out = s.score(df, s.fit(df, labels)).collect()
    assert len(out) == 5 and len({r["score"] for r in out if r["doc_id"] in (1, 2)}) == 1
    none = s.fit(df, labels.limit(0))
    assert {r["score"] for r in s.score(df, none).collect()} == {0.5}
    assert s.score(documents([]), none).count() == 0


def test_word_pairs_stay_inside_texts():
    texts = pa.array(["a b a b", "b", "", "x x"])
    words, row = s.Texts(texts).words()
    code, vocabulary = s.codes(words)
    ids, owner = s.word_pairs(vocabulary, code, row)
    assert owner.tolist() == [0, 0, 0, 3] and ids[0] == ids[2] != ids[1] and (ids > 0).all()
    again = s.word_pairs(*(lambda w, r: (lambda c: (c[1], c[0], r))(s.codes(w)))(*s.Texts(pa.array(["z q", "a b"])).words()))
    assert again[0][1] == ids[0]


def test_order_of_words_can_be_learned(documents, spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(600):
        words = [f"w{k}" for k in rng.permutation(12)]
        at = words.index("w3")
        words = [w for w in words if w != "w5"]
        at = words.index("w3")
        words.insert(at + 1 if i % 2 else at, "w5")  # "w3 w5" or "w5 w3"
        rows.append((i, " ".join(words * 3)))
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)], "doc_id long, quality int")
    docs = documents(rows)
    out = s.score(docs, s.fit(docs, labels)).where("held_out").collect()
    bad, good = (np.array([r["score"] for r in out if r["doc_id"] % 2 == k]) for k in (0, 1))
    assert (bad[:, None] < good[None, :]).mean() > 0.95
