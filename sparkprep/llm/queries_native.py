"""Queries of the operators that are native expressions throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import host_rules, line_spread, mixing, url_filters
from .common import table
from .queries import query

OP1_SQL = r"""
WITH p AS (
  SELECT page_id, html, coalesce(url, '') AS url,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (
  SELECT page_id, html, url, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
rules(verdict, h, q) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
hits AS (
  SELECT page_id, host, path, arg_max(h || q, length(h || q)) FILTER (h IS NOT NULL) AS rule,
    arg_max(verdict, length(h || q)) FILTER (h IS NOT NULL) AS rule_verdict
  FROM u LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)
  GROUP BY page_id, host, path)
-- the given pages hold no canonical or refresh link; where one is found this fails
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict,
  CASE WHEN (SELECT count(*) FROM pages WHERE regexp_matches(html, '(?i)rel\s*=\s*.?canonical|http-equiv\s*=\s*.?refresh')) > 0
    THEN error('links') ELSE NULL END::VARCHAR AS alias_group
FROM hits
"""


@query("op1_url_filters", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(table(spark, sf_dir, "pages"), url_filters.rules_table(spark, url_filters.RULES))


OP2_BASE_SQL = r"""
d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM {docs}),
wins AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) > 8)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM wins) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM again, range(8) r(j) GROUP BY doc_id),
m AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(l)::BIGINT AS n_lines FROM d LEFT JOIN rep USING (doc_id)),
f AS (
  SELECT *, n_words < 20 AS f1, 100 * n_repeat_words > 30 * n_words AS f2, 100 * n_symbols > 10 * word_chars AS f3,
    100 * n_dup_lines > 30 * n_lines AS f4 FROM m),
k AS (
  SELECT source, count(*) AS n, unnest([1, 2, 3, 4, 5]) AS rule,
    unnest([sum(f1::INT), sum(f2::INT), sum(f3::INT), sum(f4::INT), sum((f1 OR f2 OR f3 OR f4)::INT)])::DOUBLE AS k
  FROM f WHERE source IS NOT NULL AND source <> '' GROUP BY source),
prior AS (SELECT rule, sum(n) AS total, count(*) AS hosts, sum(k) / sum(n) AS m, sum(k * k / n) / sum(n) AS q FROM k GROUP BY rule),
wt AS (
  SELECT *, CASE WHEN q - m * m - m * (1 - m) * hosts / total > 0
    THEN greatest(m * (1 - m) / (q - m * m - m * (1 - m) * hosts / total) - 1, 1.0) ELSE total END AS weight FROM prior),
h AS (SELECT source, bool_or((k + weight * m) / (n + weight) > CASE WHEN rule < 5 THEN 0.5 ELSE m + 0.5 * (1 - m) END) AS host_failed
  FROM k JOIN wt USING (rule) GROUP BY source),
verdicts AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 OR f2 AS base_failed, f.source AS host,
    coalesce(host_failed, false) AS host_failed, NOT (f1 OR f2) AND NOT coalesce(host_failed, false) AS kept
  FROM f LEFT JOIN h USING (source))
"""


@query("op2_host_rules", "WITH" + OP2_BASE_SQL.replace("{docs}", "documents") + "SELECT * FROM verdicts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH s AS (
  SELECT doc_id, 'd' || coalesce((TRY_CAST(nullif(regexp_extract(source, '([0-9]{1,9})$', 1), '') AS BIGINT) % 4)::VARCHAR, '') AS domain,
    lang, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM {docs}),
t AS (SELECT * FROM s WHERE n_tokens > 0),
leaf AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM t GROUP BY ALL),
b0 AS (SELECT sum(tokens) * 0.5 AS budget FROM leaf),
n1 AS (SELECT domain, 2.0 * sum(tokens) AS cap, CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END AS w FROM leaf GROUP BY domain),
o1 AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
    sum(w) OVER (ORDER BY cap / w, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM n1),
l1 AS (SELECT max((budget - below) / open) AS level FROM o1, b0),
g1 AS (SELECT domain, least(cap, w * level) AS budget FROM o1, l1),
n2 AS (SELECT domain, lang, budget, 2.0 * sum(tokens) AS cap, CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS w
  FROM leaf JOIN g1 USING (domain) GROUP BY domain, lang, budget),
o2 AS (SELECT *, coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
    sum(w) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM n2),
l2 AS (SELECT domain, max((budget - below) / open) AS level FROM o2 GROUP BY domain),
g2 AS (SELECT domain, lang, least(cap, w * level) AS budget FROM o2 JOIN l2 USING (domain)),
n3 AS (SELECT domain, lang, source, tokens, budget, 2.0 * tokens AS cap FROM leaf JOIN g2 USING (domain, lang)),
o3 AS (SELECT *, coalesce(sum(cap) OVER (PARTITION BY domain, lang ORDER BY cap, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
    count(*) OVER (PARTITION BY domain, lang ORDER BY cap, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM n3),
l3 AS (SELECT domain, lang, max((budget - below) / open) AS level FROM o3 GROUP BY domain, lang),
g3 AS (SELECT domain, lang, source, tokens, floor(least(cap, level) + 1e-6)::BIGINT AS got FROM o3 JOIN l3 USING (domain, lang)),
p AS (SELECT *, (got // tokens)::BIGINT AS whole, (got % tokens)::BIGINT AS rest FROM g3),
run AS (
  SELECT t.doc_id, domain, lang, source, n_tokens, whole, rest,
    sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('7:' || (whole + 1) || ':' || t.doc_id), t.doc_id) AS upto
  FROM t JOIN p USING (domain, lang, source)),
picked AS (
  SELECT doc_id, domain, lang, source, n_tokens::BIGINT AS n_tokens, (whole + 1)::INT AS epoch FROM run WHERE upto <= rest
  UNION ALL
  SELECT doc_id, domain, lang, source, n_tokens::BIGINT, unnest(range(1, whole + 1))::INT FROM run)
SELECT * FROM picked
"""


@query("op9_source_mixing", OP9_SQL.replace("{docs}", "documents"))
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = mixing.choose(table(spark, sf_dir, "documents"))
    copies = F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))
    return picked.withColumn("_copy", copies).select(F.col("_id").alias("doc_id"), "domain", "lang", "source", "n_tokens", "epoch")


OP10_SQL = r"""
WITH l AS (
  SELECT doc_id, source, pos, line FROM (
    SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
    FROM {docs})),
c AS (
  SELECT line, min({doc: doc_id, pos: pos}) AS first FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
  GROUP BY line HAVING count(DISTINCT source) >= 10),
j AS (SELECT l.*, c.line IS NOT NULL AND first <> {doc: doc_id, pos: pos} AS gone FROM l LEFT JOIN c USING (line)),
cleaned AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text, sum(gone::INT)::BIGINT AS n_removed
  FROM j GROUP BY doc_id)
"""


@query("op10_line_spread", OP10_SQL.replace("{docs}", "documents") + """
SELECT doc_id, n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE sha256(c.text) END AS kept_sha256
FROM documents d LEFT JOIN cleaned c USING (doc_id)""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = line_spread.remove_boilerplate(docs, removed="n_removed")
    return out.select("doc_id", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
