from itertools import combinations

import pytest

from sentinel.llm import url_rules as u

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
URLS = ["http://A.Example.ORG/en/12", "https://example.org/en/2", "http://example.org/es/", "http://notexample.org/es/1", "http://x.com/de/1?q", "http://x.com/DE/1",
        "http://com/fr/", "http://org", "http://org/", "ftp://a.b/c#://z", "no scheme", None, "", "://", "http://", "http://h?x=/de/", "x://y://z/de/", "http://É.com/de/é"]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(x) for x in "/?#" if x in rest], default=len(rest))
    tail = rest[cut:]
    end = min([tail.index(x) for x in "?#" if x in tail], default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), tail[:end]


def ruled(host, path):
    best = None
    for rule, verdict in RULES:
        name, rest = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return best


def no_rules(spark):
    return spark.createDataFrame([], "rule string, key string, needs array<string>, confidence double, support double")


def test_hosts_paths_and_rules(spark):
    rows = list(enumerate(URLS)) + [(0, URLS[0]), (None, URLS[4])]
    df = spark.createDataFrame([(i, x, "a", "b") for i, x in rows], "page_id long, url string, host string, verdict string")
    out = u.judge(df, RULES, no_rules(spark))
    got = sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()), key=str)
    want = []
    for i, x in rows:
        host, path = split(x)
        fit = ruled(host, path)
        want.append((i, host, path, fit[0] if fit else None, fit[1] if fit else "allow"))
    assert got == sorted(want, key=str)


def test_mined_rules_against_counting_all_token_sets(spark):
    rows = [(f"http://{h}.example.net/{lang}/{i}", h == "ads-x" or (h == "b" and lang == "de")) for i in range(40) for h in ("ads-x", "b", "c") for lang in ("en", "de")]
    df = spark.createDataFrame(rows, "url string, blocked boolean")
    sets = [(frozenset(r["t"]), r["blocked"]) for r in df.select("blocked", u.tokens(df["url"]).alias("t")).collect()]
    want = {}
    for size in (1, 2, 3):
        for items in {frozenset(x) for s, _ in sets for x in combinations(sorted(s), size)}:
            hits = [b for s, b in sets if items <= s]
            if sum(hits) >= 20 and sum(hits) / len(hits) >= 0.8:
                want[" & ".join(sorted(items))] = (sum(hits) / len(hits), sum(hits) / len(sets))
    got = {r["rule"]: (r["confidence"], r["support"]) for r in u.mine(df, min_confidence=0.8).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    mined = u.mine(df, min_confidence=0.8)
    pages = spark.createDataFrame([(1, "https://ads-x.other.net/fr/1"), (2, "http://b.example.net/de/7"), (3, "http://b.example.net/en/7"), (4, None),
                                   (5, "http://ads-x.example.org/en/1")], "page_id long, url string")
    rules = {r["rule"]: r for r in mined.collect()}
    out = {r["page_id"]: r for r in u.judge(pages, RULES, mined).collect()}
    for r in pages.select("page_id", u.tokens(pages["url"]).alias("t")).collect():
        fits = [x for x in rules.values() if set(x["needs"]) <= set(r["t"])]
        best = max(fits, key=lambda x: (x["confidence"], x["support"], x["rule"]))["rule"] if fits else None
        assert out[r["page_id"]]["mined_rule"] == best
    assert out[1]["verdict"] == out[2]["verdict"] == "block" and out[3]["verdict"] == out[4]["verdict"] == "allow" and out[5]["verdict"] == "block"


def test_no_labels_and_empty(spark):
    labelled = spark.createDataFrame([("http://a.b/c", None), (None, True)], "url string, blocked boolean")
    assert u.mine(labelled).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string")
    assert u.judge(pages, RULES, u.mine(labelled)).count() == 0
