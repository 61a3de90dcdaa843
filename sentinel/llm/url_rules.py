"""URL filters: explicit host and path rules, then association rules mined from labelled URLs.

URLs become sets of tokens (scheme, host and its parents, words of host labels, path segments with numbers made
equal, file ending, query keys, fragment). Spark's FP-growth mines token sets of labelled URLs; rules that end in the block
label and pass the support and confidence limits are kept. Matching is an inverted index: a rule is filed under its
rarest token, a URL looks up its tokens, and a rule fires if all its tokens are in the URL. Distinct URLs are matched once.

Defined cases: a null URL, or one without ``://``, has empty host and path, no tokens and the default verdict. Equal rows get equal
results. Labels that are null are not used; without any labels, or without rules that pass, the verdict is the default.
Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentinel.functions.storage import cut_lineage

BLOCK = "label=block"
MAX_TOKENS = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    found = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest fitting rule, or null. A rule like ``org/a`` fits host org and its subdomains, and paths that start with /a."""
    out = F.lit(None)
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL; empty for a null URL or one without a scheme."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("h:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    words = F.transform(F.flatten(F.transform(labels, lambda x: F.split(x, "-"))), lambda w: F.concat(F.lit("w:"), w))
    segments = F.filter(F.split(F.lower(path), "/"), lambda s: s != "")
    segments = F.transform(segments, lambda s: F.concat(F.lit("p:"), F.regexp_replace(F.regexp_replace(s, r"\.[a-z0-9]+$", ""), "[0-9]+", "0")))
    ending = F.regexp_extract(F.lower(path), r"\.([a-z0-9]+)$", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.concat(F.lit("q:"), F.lower(F.split(p, "=")[0])))
    single = F.filter(F.array(
        F.concat(F.lit("s:"), F.lower(F.regexp_extract(url, r"^([^:/?#]*)://", 1))),
        F.when(ending != "", F.concat(F.lit("e:"), ending)), F.when(F.instr(url, "#") > 0, F.lit("fragment"))), lambda t: t.isNotNull())
    everything = F.array_distinct(F.concat(parents, words, segments, keys, single))
    return F.when(F.coalesce(host != "", F.lit(False)), everything).otherwise(F.array().cast("array<string>"))


def _without_idle_tokens(rules: DataFrame) -> DataFrame:
    """Rules without those that have a rule of one token less and at least the same confidence."""
    shorter = rules.select(F.col("needs").alias("_needs"), F.col("confidence").alias("_least"))
    longer = rules.select("needs", "confidence", F.explode("needs").alias("_token")).withColumn("_needs", F.array_remove("needs", F.col("_token")))
    idle = longer.join(shorter, "_needs").where("_least >= confidence").select("needs").distinct()
    return rules.join(idle, "needs", "left_anti")


def mine(labelled: DataFrame, min_support: float = 0.001, min_confidence: float = 0.6, least_rows: int = 20, max_tokens: int | None = MAX_TOKENS) -> DataFrame:
    """Rules (rule, needs, key, confidence, support) from rows of url and blocked (boolean); key is the rarest token of the rule.

    A rule must hold for ``min_support`` of the labelled rows and for ``least_rows`` of them.
    ``max_tokens`` of None keeps rules of any length and leaves out those that say no more than a shorter rule: if one token can go
    and the confidence is no lower, the shorter rule fires on the same URLs and more, so no verdict changes."""
    baskets = labelled.where("url IS NOT NULL AND blocked IS NOT NULL").select("blocked", tokens(F.col("url")).alias("items")).where(F.size("items") > 0)
    baskets = baskets.select(F.when(F.col("blocked"), F.array_append("items", F.lit(BLOCK))).otherwise(F.col("items")).alias("items"))
    baskets = cut_lineage(baskets)
    rows = max(baskets.count(), 1)
    support = min(max(min_support, least_rows / rows), 1.0)
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where(F.element_at("consequent", 1) == BLOCK)
    if max_tokens is not None:
        rules = rules.where(F.size("antecedent") <= max_tokens)
    single = model.freqItemsets.where(F.size("items") == 1).select(F.element_at("items", 1).alias("key"), "freq")
    rules = rules.select(F.array_sort("antecedent").alias("needs"), "confidence", "support").withColumn("rule", F.array_join("needs", " & "))
    if max_tokens is None:
        rules = _without_idle_tokens(cut_lineage(rules))
    ranked = rules.select("*", F.explode("needs").alias("key")).join(single, "key")
    return ranked.groupBy("rule").agg(F.min_by("key", F.struct("freq", "key")).alias("key"), F.first("needs").alias("needs"),
                                      F.first("confidence").alias("confidence"), F.first("support").alias("support"))


def fired(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """For each distinct URL on which mined rules fire: url and the most confident rule (then the most supported)."""
    looked_up = urls.where("url IS NOT NULL").select("url").distinct().withColumn("_has", tokens(F.col("url")))
    met = looked_up.select("url", "_has", F.explode("_has").alias("key")).join(rules, "key")
    met = met.where(F.size(F.array_except("needs", "_has")) == 0)
    return met.groupBy("url").agg(F.max_by("rule", F.struct("confidence", "support", "rule")).alias("mined_rule"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], mined: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict and mined_rule for every row of ``pages``."""
    url = F.col("url")
    rows = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("_fit", rule_for(F.col("host"), F.col("path"), rules))
    rows = rows.join(fired(pages, cut_lineage(mined)), "url", "left")
    learned = F.when(F.col("mined_rule").isNotNull(), F.lit("block")).otherwise(F.lit(default))
    return rows.select("page_id", "host", "path", F.col("_fit.rule").alias("rule"), F.coalesce(F.col("_fit.verdict"), learned).alias("verdict"), "mined_rule")
