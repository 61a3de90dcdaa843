import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sentinel.llm import conversation_repair as c

BLANKS = " \t\n\x0b\x0c\r"
GOOD = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        solid = text.strip(BLANKS)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "none")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Smallest (cost, audit) over all edit sequences, with what they leave; a plain search from the end over (row, initials so far)."""
    marks, n = faults(rows), len(rows)
    table = {}
    prefix = lambda s: re.fullmatch(r"(s?((ua)*u?))?", s) is not None
    state = lambda s: s if s in ("", "s") else "u" if s[-1] == "u" else "ua"

    def go(i, s, inserts):
        key = (i, s, inserts)
        if key in table:
            return table[key]
        found = []
        if i == n and GOOD.fullmatch(s):
            found.append((0, "", ()))
        if inserts < 3:
            for r in ("user", "assistant"):
                if prefix(s + r[0]):
                    cost, audit, left = go(i, state(s + r[0]), inserts + 1)
                    found.append((cost + 2, "I" + audit, ((r, ""),) + left))
        if i < n:
            role, text = rows[i]
            cost, audit, left = go(i + 1, s, 0)
            found.append((cost + 3, "D" + audit, left))
            if marks[i] in ("none", "truncated"):
                extra = marks[i] == "truncated"
                for edit, new, price in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
                    if new and prefix(s + new[0]):
                        cost, audit, left = go(i + 1, state(s + new[0]), 0)
                        found.append((cost + price + extra, edit + audit, ((new, text),) + left))
        table[key] = min(found, default=(10**9, "", ()))
        return table[key]

    return go(0, "", 0)


def expected(table):
    convs = defaultdict(list)
    for r in damaged(table):
        convs[r[0]].append(r)
    out = []
    for conv in {r[0] for r in table}:
        rows = sorted(convs[conv], key=lambda r: (r[1] is not None, r[1] or 0))
        turns = [r[1] for r in rows if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [(r[2], r[3]) for r in rows]
        marks = faults(pairs)
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in itertools.pairwise(pairs))
        cost, audit, left = cheapest(pairs)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
        out.append((conv, gaps, *(marks.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(out, key=str)


def table(spark, rows, extra=()):
    columns = "conv_id long, turn long, role string, text string" + "".join(f", {e} string" for e in extra)
    return spark.createDataFrame([(*r, *["x"] * len(extra)) for r in rows], columns)


def report(spark, rows, extra=()):
    convs = table(spark, rows, extra)
    return sorted((tuple(r) for r in c.audit_report(convs, c.damage(convs)).collect()), key=str)


def test_given_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert report(spark, rows) == expected(rows)


def test_odd_conversations(spark):
    rng = random.Random(3)
    rows, roles = [], ["user", "assistant", "system", "tool", "", None, "User", "u", "umpire"]
    for conv in range(400):
        for turn in sorted(rng.sample(range(-3, 12), rng.randrange(1, 9))):
            rows.append((conv, turn, rng.choice(roles[:3] if conv % 2 else roles), rng.choice(["Yes.", "No!", "so", " \n", "", None, "Is it? ", "Ä.\t", "é", f"t{turn}."])))
    rows += [(None, 1, "user", "a."), (None, 2, "assistant", "b."), (500, None, "user", "x."), (501, None, None, None), (502, None, "assistant", "x."), (502, 5, "user", "y?")]
    assert report(spark, rows, extra=("_conv", "cost", "_part", "edits")) == expected(rows)


@pytest.mark.parametrize("length", [1, 2, 3, 4])
def test_automaton_against_search(length):
    symbols = [(r, f) for r in ("system", "user", "assistant", "tool") for f in ("none", "blank", "duplicate", "truncated")]
    rng = random.Random(length)
    words = list(itertools.product(range(16), repeat=length))
    words = sorted(words if len(words) <= 256 else rng.sample(words, 1500), key=lambda w: w[::-1])
    machine = c.Automaton.empty()
    for word in words:
        made = []
        for n, k in enumerate(word):
            role, fault = symbols[k]
            made.append((role, {"none": f"text {n}.", "blank": " ", "truncated": f"open {n}"}.get(fault, "twice.")))
        twice = {(r, "twice.") for (r, t) in made if t == "twice."}
        head = sorted(twice)
        full = head + made
        letters = "".join(chr(65 + 4 * ("sua".find(r[:1]) % 4) + c.FAULTS.index(f)) for (r, _), f in zip(full, faults(full)))
        machine.move(letters)
        cost, edits = machine.best()
        want = cheapest(full)
        assert (cost, edits.translate(c.AUDIT)) == want[:2], letters


def test_shared_ends_are_made_once():
    machine = c.Automaton.empty()
    for word in sorted(["EIEI", "AEIEI", "EIEIEI", "IEI"], key=lambda w: w[::-1]):
        machine.move(word)
    assert machine.made == len({w[i:] for w in ("EIEI", "AEIEI", "EIEIEI", "IEI") for i in range(len(w))})


def test_a_conversation_of_many_rows_spreads_over_parts(spark):
    rows = [(7, t, ("user", "assistant")[t % 2], f"line {t % 700}.") for t in range(6000)] + [(8, 0, "user", "hi."), (8, 1, "assistant", "yes.")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # parts this small would be joined
    try:
        places = c.ordered(c.damage(table(spark, rows)))
        assert places.where("_conv = '=7'").select("_part").distinct().count() > 2
        got = {r[0]: r for r in report(spark, rows)}
        again = {r[0]: r for r in report(spark, rows[::-1])}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    together = {r[0]: r for r in report(spark, rows)}
    assert got == together == again
    kept = damaged(rows)
    assert len(got[7][7].replace("I", "")) == sum(r[0] == 7 for r in kept)
    assert got[7][2:5] == tuple(faults([(r[2], r[3]) for r in kept if r[0] == 7]).count(f) for f in ("blank", "duplicate", "truncated"))


def test_repaired_rows_follow_the_grammar(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    new = c.repair(c.damage(rows)).repaired.collect()
    by = defaultdict(list)
    for r in sorted(new, key=lambda r: (r["_conv"], r["_place"], r["_nth"])):
        by[r["_conv"]].append(r["role"][:1])
    assert all(GOOD.fullmatch("".join(v)) for v in by.values())


def test_empty_table(spark):
    assert report(spark, []) == [] and c.damage(table(spark, [])).where(F.col("turn") > 0).count() == 0
