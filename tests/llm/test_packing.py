import random
from collections import defaultdict

from sentinel.llm import packing


def check(rows, sizes, capacities):
    """Every document is covered once, no bin overflows or overlaps, and every bin has the smallest length that fits."""
    covered, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        covered[r["doc_id"], r["size"], r["copy"]].append((r["start"], r["length"]))
        if r["length"]:
            bins[r["bin_id"], r["capacity"]].append((r["offset"], r["length"]))
        else:
            assert r["bin_id"] is None and r["capacity"] is None and r["offset"] is None
    assert all(k[1] == sum(n for _, n in v) for k, v in covered.items())
    assert sorted(((k[0], k[1]) for k in covered), key=str) == sorted(sizes, key=str)
    for parts in covered.values():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
    for (_, capacity), parts in bins.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert capacity == min(c for c in capacities if c >= at)
    return bins


def brute(sizes, capacities, price):
    """Best fit written out: scan all bins for the least room left."""
    bins, left = [], sum(sizes)
    for s in sizes:
        fits = [(room - s, i) for i, (room, _) in enumerate(bins) if room >= s]
        if fits:
            _, i = min(fits)
        else:
            c = min((c for c in sorted(capacities) if c >= s), key=lambda c: (price(c) / min(c, left), c))
            bins.append([c, 0])
            i = len(bins) - 1
        bins[i][0] -= s
        bins[i][1] += s
        left -= s
    return sorted(min(c for c in capacities if c >= used) for _, used in bins)


def test_group_agrees_with_scanning_all_bins():
    rng = random.Random(1)
    for _ in range(30):
        sizes = sorted((rng.randint(1, 64) for _ in range(rng.randint(1, 200))), reverse=True)
        bins, capacity, _ = packing.pack_group(sizes, (16, 32, 64))
        assert sorted(dict(zip(bins, capacity)).values()) == brute(sizes, (16, 32, 64), packing.cost)


def test_dear_small_bins_open_large_ones():
    bins, capacity, _ = packing.pack_group([10] * 6, (16, 64), price=lambda c: 100 + c)
    assert set(bins) == {0} and set(capacity) == {64}


def test_pack_documents(documents):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.choice([1, 30, 511, 512, 513, 2048, 2049, 9000]))) for i in range(200)]
    rows += [(500, None), (501, ""), (502, " \n"), (None, "a b"), (7, rows[7][1]), (7, rows[7][1])]
    df = documents(rows, extra=("copy", "bin_id", "piece", "length"))
    out = packing.pack(df, group_pieces=100).collect()
    check(out, [(i, len((t or "").split())) for i, t in rows], packing.CAPACITIES)


def test_group_size_is_respected_and_bins_are_full(documents):
    rng = random.Random(3)
    df = documents([(i, " ".join(["w"] * rng.randint(1, 400))) for i in range(600)])
    out = packing.pack(df).collect()
    bins = {(r["bin_id"], r["capacity"]) for r in out}
    assert sum(r["length"] for r in out) / sum(c for _, c in bins) > 0.95


def test_empty(documents):
    assert packing.pack(documents([])).count() == 0
