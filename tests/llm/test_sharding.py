import zlib
from collections import defaultdict

import pytest

from sentinel.llm import sharding as s


def test_shards_slots_and_growth(documents, monkeypatch):
    monkeypatch.setattr(s.with_slots, "__defaults__", (50,))
    rows = [(i, f"text {i % 40}") for i in range(3000)] + [(5, "other"), (None, None), (None, None), (None, ""), (6, "text 6"), (7, "é")]
    out = s.rendezvous(documents(rows, extra=("shard", "slot", "copy", "size")), [1.0] * 8).collect()
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in out) == want
    slots, of_key = defaultdict(list), defaultdict(set)
    for r in out:
        slots[r["shard"]].append(r["slot"])
        of_key[r["doc_id"]].add((r["shard"], r["grown_shard"]))
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 8)
    assert set(slots) == set(range(8)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(len(v) == 1 for v in of_key.values())
    assert all(250 < len(v) < 520 for v in slots.values())
    moved = sum(r["grown_shard"] == 8 for r in out) / len(out)
    assert 0.07 < moved < 0.16


def test_weights(spark):
    rows = spark.range(20_000).select(s.shard_of("id", [1.0, 3.0, 0.5]).alias("shard")).groupBy("shard").count().collect()
    share = {r["shard"]: r["count"] / 20_000 for r in rows}
    assert share == pytest.approx({0: 1 / 4.5, 1: 3 / 4.5, 2: 0.5 / 4.5}, abs=0.015)


def test_repeated_rows_take_consecutive_places(documents):
    out = s.rendezvous(documents([(1, "x")] * 25_000), [1.0] * 8).collect()
    assert sorted(r["slot"] for r in out) == list(range(25_000))


def test_empty(documents):
    assert s.rendezvous(documents([]), [1.0] * 8).count() == 0
