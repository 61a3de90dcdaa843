"""Rules of more than three tokens."""

from itertools import combinations, product

from sentinel.llm import queries
from sentinel.llm import url_rules as u


def labelled_urls():
    """Blocked only where host, segment, ending and query key all have their first value."""
    kinds = list(product(("ads", "b"), ("promo", "news"), ("html", "gif"), ("click", "id")))
    return [(30 * k + i, f"http://{h}.net/{seg}/{30 * k + i}.{end}?{key}=1", k == 0) for k, (h, seg, end, key) in enumerate(kinds) for i in range(30)]


def test_op7_blocks_a_pattern_of_four_tokens(spark, tmp_path):
    rows = labelled_urls()
    spark.createDataFrame([(i, url) for i, url, _ in rows], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(i, 1, int(b)) for i, _, b in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = {r["page_id"]: r["verdict"] for r in queries.op7_url_rules(spark, str(tmp_path)).collect()}
    assert out == {i: "block" if b else "allow" for i, _, b in rows}


def test_rules_of_any_length_against_counting(spark):
    df = spark.createDataFrame([(url, b) for _, url, b in labelled_urls()], "url string, blocked boolean")
    sets = [(frozenset(r["t"]), r["blocked"]) for r in df.select("blocked", u.tokens(df["url"]).alias("t")).collect()]
    passing = {}
    for items in {frozenset(x) for s in {s for s, _ in sets} for n in range(1, len(s) + 1) for x in combinations(s, n)}:
        hits = [b for s, b in sets if items <= s]
        if sum(hits) >= 20 and sum(hits) / len(hits) >= 0.6:
            passing[items] = sum(hits) / len(hits)
    want = {x for x, c in passing.items() if not any(passing.get(x - {t}, 0) >= c for t in x)}
    got = [frozenset(r["needs"]) for r in u.mine(df, max_tokens=None).collect()]
    assert len(got) == len(want) and set(got) == want and {len(x) for x in want} == {4}
