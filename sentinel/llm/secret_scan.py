"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Three fixed patterns give the base spans. A fourth proposes further long mixed tokens. Every candidate value is
hashed, and over the whole corpus its distinct owners and repositories are counted. A value that several owners or
many repositories hold is a copied example; a value of one owner that looks random is called live. Live tokens that no base
span covers are added as spans of kind token.

Positions are code points, the end is exclusive. Java's matcher finds the leftmost, non-overlapping matches; the
lengths of the pieces between them (``split``) give their positions.

Defined cases: a null text is empty and has no spans. Rows equal in doc_id and text get equal results and count
once per owner and repository. A null owner or repository counts as one of its own. Overlapping spans of different
kinds are all reported, and ``redact`` replaces their union once. Other columns pass through ``redact`` unchanged. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentinel.functions.storage import cut_lineage
from sentinel.llm.common import row_key, unpacked, whole_row

# The kinds of spans in the order of the report, their patterns, the group that is the value, its least length.
# A run of one character class is long enough or holds no match at all, so access and hex carry their length in the pattern.
# An assignment that is too short still uses up its text, so its length is checked after matching.
KINDS = ("assign", "access", "hex", "token")
PATTERNS = {
    "assign": (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"""
               r"""[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]{12,}", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
    "token": (r"[A-Za-z0-9_+/=-]{20,}", 0, 20),
}
PLACEHOLDERS = r"(?i)example|placeholder|changeme|your|dummy|sample|test|xxxx|0000|1234|abcd"
MIXED = (r"[a-z]", r"[A-Z]", r"[0-9]")
EXAMPLE_OWNERS, EXAMPLE_REPOS = 3, 6
LEAST_DIFFERENT = 8
SALTS = 16
_BLOCK = 256
SPAN = "array<struct<start:bigint,kind:int,end:bigint,hash:string,odd:boolean>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(lengths: Column) -> Column:
    """Sums of all earlier elements for each element, in blocks, so that a text of many matches costs little more than linear time."""
    zero = F.lit(0).cast("long")
    total = lambda xs: F.aggregate(xs, zero, lambda a, x: a + x)
    block = lambda xs, b: F.slice(xs, (b * _BLOCK + 1).cast("int"), _BLOCK)

    def sums_of(xs: Column) -> Column:
        blocks = F.sequence(zero, F.floor((F.size(xs) - 1) / _BLOCK))
        return _let(F.transform(blocks, lambda b: total(block(xs, b))), lambda sums: F.flatten(F.transform(blocks, lambda b: _let(
            block(xs, b), lambda part: _let(total(F.slice(sums, F.lit(1), b.cast("int"))), lambda before: F.transform(
                part, lambda _, i: before + total(F.slice(part, F.lit(1), i))))))))

    return _let(lengths, sums_of)


def _kind_spans(text: Column, kind: str) -> Column:
    """The spans of one kind. Short matches are dropped after matching."""
    pattern, group, least = PATTERNS[kind]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p).cast("long"))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else None

    def located(m: Column) -> Column:
        lengths = F.transform(m, lambda x: F.length(x).cast("long"))
        pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(m)), lengths, lambda gap, n: F.struct((gap + n).alias("both"), n.alias("n")))

        def ends(ps: Column) -> Column:
            before = _running(F.transform(ps, lambda p: p["both"]))
            return F.zip_with(before, ps, lambda b, p: F.struct((b + p["both"] - p["n"]).alias("start"), (b + p["both"]).alias("end")))

        found = F.zip_with(_let(pairs, ends), m if values is None else values, lambda at, v: F.struct(
            at["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), at["end"].alias("end"), v.alias("value")))
        good = lambda s: (F.length(s["value"]) >= least) & (_looks_mixed(s["value"]) if kind == "token" else F.lit(True))
        return F.transform(F.filter(found, good), lambda s: F.struct(
            s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("hash"), _looks_random(s["value"]).alias("odd")))

    return _let(matches, lambda m: F.when(F.size(m) > 0, located(m)).otherwise(F.array().cast(SPAN)))


def _looks_mixed(value: Column) -> Column:
    return value.rlike(MIXED[0]) & value.rlike(MIXED[1]) & value.rlike(MIXED[2])


def _looks_random(value: Column) -> Column:
    """Many different characters and no word that marks a placeholder."""
    return (F.size(F.array_distinct(F.split(value, ""))) >= LEAST_DIFFERENT) & ~value.rlike(PLACEHOLDERS)


def candidates(docs: DataFrame, owner: Column, repo: Column) -> DataFrame:
    """doc_id, its row key, owner, repo, and all candidate spans of every row."""
    text = F.coalesce("text", F.lit(""))
    base = F.concat(*(_kind_spans(text, k) for k in KINDS[:3]))
    free = lambda spans, tokens: F.concat(spans, F.filter(tokens, lambda t: ~F.exists(
        spans, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))))
    spans = _let(base, lambda s: free(s, _kind_spans(text, "token")))
    return docs.select("doc_id", row_key("doc_id", "text").alias("_key"), owner.alias("_owner"), repo.alias("_repo"), spans.alias("spans"))


def ownership(found: DataFrame) -> DataFrame:
    """Per candidate hash its distinct owners and repositories. Equal (hash, owner, repo) meet before the shuffle."""
    values = found.select(F.explode(F.array_distinct(F.transform("spans", lambda s: s["hash"]))).alias("hash"),
                          F.struct("_owner").alias("owner"), F.struct("_owner", "_repo").alias("repo"))
    by_repo = values.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("_one"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("_repos"))
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("_repos").alias("repos"))


def scan(docs: DataFrame, owner: Column, repo: Column) -> DataFrame:
    """Per distinct (doc_id, text) with candidates: _key and ``spans`` (start, kind, end, verdict), ordered.

    verdict: example, live or weak. Base spans are always listed, tokens only if live. A hash that very many rows
    hold is joined in ``SALTS`` parts.
    """
    found = cut_lineage(candidates(docs, owner, repo).where(F.size("spans") > 0))
    known = ownership(found).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    once = found.groupBy("_key").agg(F.first("spans").alias("spans"))
    single = once.select("_key", F.explode("spans").alias("s")).select("_key", "s.*").withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(SALTS)).cast("int"))
    copied = (F.col("owners") >= EXAMPLE_OWNERS) | (F.col("repos") >= EXAMPLE_REPOS)
    verdict = F.when(copied, "example").when((F.col("owners") == 1) & F.col("odd"), "live").otherwise("weak")
    judged = single.join(known, ["hash", "_salt"]).withColumn("verdict", verdict)
    judged = judged.where((F.col("kind") < KINDS.index("token")) | (F.col("verdict") == "live"))
    return judged.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "verdict"))).alias("spans"))


def _line(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat(name(s), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, owner: Column, repo: Column) -> DataFrame:
    """One row per row of ``docs``: counts of base spans, their digest, all spans, and how many are live or examples."""
    rows = docs.select("doc_id", row_key("doc_id", "text").alias("_key")).join(scan(docs, owner, repo), "_key", "left")
    rows = rows.withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind:int,end:bigint,verdict:string>>")))
    count = lambda test: F.size(F.filter("spans", test)).cast("long")
    of_kind = lambda k: count(lambda s: s["kind"] == k)
    base = F.filter("spans", lambda s: s["kind"] < KINDS.index("token"))
    return rows.select(
        "doc_id", *(of_kind(k).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(_line(base), 256).alias("base_sha256"), _line(F.col("spans")).alias("spans"),
        count(lambda s: s["verdict"] == "live").alias("n_live"), count(lambda s: s["verdict"] == "example").alias("n_example"))


def redact(docs: DataFrame, owner: Column, repo: Column, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with base spans and live tokens replaced by ``mark``; copied examples and all other text stay. n_chars follows the text, if there is such a column."""
    hidden = scan(docs, owner, repo).select("_key", F.filter("spans", lambda s: s["verdict"] != "example").alias("_spans")).where(F.size("_spans") > 0)
    # Only rows that can hold a candidate are shuffled with their texts.
    may = F.coalesce(F.col("text").rlike("|".join(f"(?:{p})" for p, _, _ in PATTERNS.values())), F.lit(False))
    rest, suspects = docs.where(~may), docs.where(may).select(row_key("doc_id", "text").alias("_key"), whole_row(docs))
    text = F.col("_doc.text")
    step = lambda a, s: F.when(s["start"] >= a["at"], F.struct(
        F.concat(a["out"], F.substring(text, a["at"] + 1, (s["start"] - a["at"]).cast("int")), F.lit(mark)).alias("out"), s["end"].cast("int").alias("at"),
    )).otherwise(F.struct(a["out"].alias("out"), F.greatest(a["at"], s["end"].cast("int")).alias("at")))
    done = F.aggregate("_spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step,
                       lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    joined = suspects.join(hidden, "_key", "left").select("_doc", F.when(F.col("_spans").isNull(), text).otherwise(done).alias("_text"), F.col("_spans").isNull().alias("_same"))
    changed = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("_same"), F.col("_doc.n_chars")).otherwise(F.length("_text").cast(docs.schema["n_chars"].dataType))
    return rest.unionByName(joined.select(*unpacked(joined, docs.columns, changed)))
