"""Registered queries of the operators, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinel.llm import (
    conversation_repair, line_dedup, minhash, mixing, multi_index, packing, periodic_runs, quality_rules, secret_scan, sharding, subword,
    surrogates, url_rules,
)

URL_RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
SECRET_KEY = "a fixed key, so that reruns of the query agree"
SHARD_WEIGHTS = [1.0] * 8


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(_table(spark, sf, "documents"))


def op2_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    trees = quality_rules.fit(docs, _table(spark, sf, "labels"))
    return quality_rules.judge(docs, trees)


def op3_multi_index(spark: SparkSession, sf: str) -> DataFrame:
    return multi_index.search(_table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op4_secret_scans(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan.report(_table(spark, sf, "documents"), F.col("source"), F.concat_ws("/", "source", "lang"))


def op5_subword_classifier(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    return subword.score(docs, subword.fit(docs, _table(spark, sf, "labels")))


def op6_circulant_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf, "documents"), percent=85)


def op7_url_rules(spark: SparkSession, sf: str) -> DataFrame:
    """A page is labelled by the document that its path names: blocked if of low quality or toxic."""
    pages, labels = _table(spark, sf, "pages"), _table(spark, sf, "labels")
    named = pages.select("url", F.regexp_extract("url", r"/([0-9]{1,18})(?:[^0-9/][^/]*)?/?$", 1).try_cast("long").alias("doc_id"))
    labelled = named.join(labels, "doc_id").select("url", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("blocked"))
    return url_rules.judge(pages, URL_RULES, url_rules.mine(labelled, max_tokens=None))


def op8_pivotal_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_pii_surrogates(spark: SparkSession, sf: str) -> DataFrame:
    return surrogates.replace(_table(spark, sf, "documents"), SECRET_KEY).select("doc_id", "text", "n_entities")


def op10_rendezvous_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.rendezvous(_table(spark, sf, "documents"), SHARD_WEIGHTS)


def op11_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = line_dedup.report(_table(spark, sf, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    conversations = _table(spark, sf, "conversations")
    return conversation_repair.audit_report(conversations, conversation_repair.damage(conversations))


def op13_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    return periodic_runs.report(_table(spark, sf, "documents"), periodic_runs.repeat_tails)


QUERIES = {f.__name__: f for f in (
    op1_best_fit_packing, op2_quality_rules, op3_multi_index, op4_secret_scans, op5_subword_classifier,
    op6_circulant_minhash, op7_url_rules, op8_pivotal_mixing, op9_pii_surrogates, op10_rendezvous_sharding,
    op11_line_dedup, op12_conversation_repair, op13_periodic_runs)}

_WORD = r"[^\x20\x09-\x0D]+"


def _kind_sql(kind: str) -> str:
    pattern, group, least = secret_scan.PATTERNS[kind]
    pattern = pattern.replace("'", "''")
    mixed = "".join(f" AND regexp_matches(v[i], '{p}')" for p in secret_scan.MIXED) if kind == "token" else ""
    return f"""
  SELECT doc_id, source, lang, {secret_scan.KINDS.index(kind)} AS kind, v[i] AS value,
         list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS a, length(m[i]) AS n
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT doc_id, source, lang, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS v,
           string_split_regex(t, '{pattern}') AS g FROM d))
  WHERE length(v[i]) >= {least}{mixed}"""


SQL = {
    "op4_secret_scans": f"""
WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(map(_kind_sql, secret_scan.KINDS))}),
placed AS (SELECT doc_id, source, lang, kind, value, a::BIGINT AS a, (a + n)::BIGINT AS b FROM found),
candidate AS (SELECT * FROM placed p WHERE kind < 3 OR NOT EXISTS (
  SELECT 1 FROM placed q WHERE q.doc_id = p.doc_id AND q.kind < 3 AND q.a < p.b AND p.a < q.b)),
owned AS (SELECT value, count(DISTINCT source) AS owners, count(DISTINCT concat_ws('/', source, lang)) AS repos FROM candidate GROUP BY value),
judged AS (SELECT c.*, CASE WHEN owners >= {secret_scan.EXAMPLE_OWNERS} OR repos >= {secret_scan.EXAMPLE_REPOS} THEN 'example'
    WHEN owners = 1 AND len(list_distinct(string_split(value, ''))) >= {secret_scan.LEAST_DIFFERENT}
         AND NOT regexp_matches(value, '{secret_scan.PLACEHOLDERS}') THEN 'live' ELSE 'weak' END AS verdict
  FROM candidate c JOIN owned USING (value)),
listed AS (SELECT *, ['assign', 'access', 'hex', 'token'][kind + 1] || ':' || a || ':' || b AS line FROM judged WHERE kind < 3 OR verdict = 'live'),
rows AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(line, ',' ORDER BY a, kind) FILTER (kind < 3) AS base, string_agg(line, ',' ORDER BY a, kind) AS spans,
    count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'example') AS n_example FROM listed GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN rows USING (doc_id)""",
    "op6_circulant_minhash": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
shingles AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
sets AS (SELECT *, len(s) AS n FROM shingles),
class AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY CASE WHEN n > 0 THEN list_sort(s)::VARCHAR ELSE doc_id::VARCHAR END) AS rep FROM sets),
one AS (SELECT s.doc_id AS rep, s.n, unnest(s.s) AS x FROM sets s JOIN class c ON c.doc_id = s.doc_id AND c.rep = c.doc_id),
pair AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS n_both
  FROM one a JOIN one b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.rep, b.rep),
link AS (SELECT a, b FROM pair WHERE 100 * n_both >= 85 * (na + nb - n_both)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT DISTINCT rep AS node, rep AS low FROM class UNION SELECT e.b, r.low FROM reach r JOIN edge e ON e.a = r.node WHERE r.low < e.b),
lowest AS (SELECT node, min(low) AS low FROM reach GROUP BY node)
SELECT c.doc_id, c.n AS n_shingles, l.low AS component_id, c.doc_id = l.low AS kept FROM class c JOIN lowest l ON l.node = c.rep""",
    "op11_line_dedup": f"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM l),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{line_dedup.UPPER}', '{line_dedup.LOWER}') AS key FROM line),
common AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= {line_dedup.LEAST_LENGTH} GROUP BY key HAVING count(DISTINCT doc_id) >= {line_dedup.LEAST_DOCS}),
judged AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.keeper AS gone FROM keyed k LEFT JOIN common c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id""",
    "op12_conversation_repair": """
WITH RECURSIVE original AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::UBIGINT) AS name FROM conversations),
summed AS (SELECT *, xor(list_reduce(list_concat([4294967295::UBIGINT], name), lambda c, b: list_reduce(
    list_concat([xor(c, b)], list_transform(range(8), lambda z: 0::UBIGINT)), lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))), 4294967295::UBIGINT) % 20 AS kind FROM original),
broken AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM summed WHERE kind <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, role[1] AS r FROM broken),
marked AS (SELECT *, regexp_extract(text, '[^\x20\x09-\x0D]([\x20\x09-\x0D]*)$') AS last_one,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || r AS pair FROM numbered),
faulty AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN again THEN 'd'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault FROM marked),
counted AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id),
-- grammar states: 1 nothing yet, 2 after s, 3 after u, 4 after a; inserts lead from 1, 2 and 4 to 3 and from 3 to 4
walk AS (
  SELECT conv_id, n AS i, [{c: 0, a: '', o: []::VARCHAR[]}, {c: 4, a: 'II', o: ['user:', 'assistant:']}, {c: 2, a: 'I', o: ['assistant:']}, {c: 0, a: '', o: []::VARCHAR[]}] AS f FROM counted
  UNION ALL
  SELECT conv_id, i - 1, list_transform([1, 2, 3, 4], lambda s: list_sort([g[s],
      {c: g[CASE s WHEN 3 THEN 4 ELSE 3 END].c + 2, a: 'I' || g[CASE s WHEN 3 THEN 4 ELSE 3 END].a,
       o: list_concat([CASE s WHEN 3 THEN 'assistant:' ELSE 'user:' END], g[CASE s WHEN 3 THEN 4 ELSE 3 END].o)},
      {c: g[CASE s WHEN 3 THEN 3 ELSE 4 END].c + 4, a: 'II' || g[CASE s WHEN 3 THEN 3 ELSE 4 END].a,
       o: list_concat([CASE s WHEN 3 THEN 'assistant:' ELSE 'user:' END, CASE s WHEN 3 THEN 'user:' ELSE 'assistant:' END], g[CASE s WHEN 3 THEN 3 ELSE 4 END].o)}])[1])
  FROM (SELECT w.conv_id, w.i, list_transform([1, 2, 3, 4], lambda s: list_sort([
      {c: f[s].c + 3, a: 'D' || f[s].a, o: f[s].o},
      {c: CASE WHEN t.fault IN ('b', 'd') OR NOT ((s = 1 AND t.r = 's') OR (s <> 3 AND t.r = 'u') OR (s = 3 AND t.r = 'a')) THEN 1000000000 ELSE (t.fault = 't')::INT END
          + f[CASE t.r WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].c, a: 'K' || f[CASE t.r WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].a,
       o: list_concat([t.role || ':' || t.text], f[CASE t.r WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].o)},
      {c: CASE WHEN t.fault IN ('b', 'd') THEN 1000000000 ELSE 2 + (t.fault = 't')::INT END + f[CASE s WHEN 3 THEN 4 ELSE 3 END].c,
       a: 'R' || f[CASE s WHEN 3 THEN 4 ELSE 3 END].a,
       o: list_concat([CASE s WHEN 3 THEN 'assistant:' ELSE 'user:' END || t.text], f[CASE s WHEN 3 THEN 4 ELSE 3 END].o)}])[1]) AS g
    FROM walk w JOIN faulty t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i)),
best AS (SELECT conv_id, f[1] AS b FROM walk WHERE i = 0)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(array_to_string(b.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id""",
}
