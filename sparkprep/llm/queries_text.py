"""Queries of the operators that work on whole texts inside tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff_lm, decontaminate, setsketch, style_tree, suffix_dedup, token_secrets
from .common import table
from .queries import query

@query("op3_style_tree")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = style_tree.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {docs}),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(13, len(w)) AS m, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms WHERE len(w) >= m)),
hits AS (SELECT DISTINCT doc_id, m, i, item_id FROM dw JOIN bw USING (m, g)),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT doc_id, i, unnest(range(m)) AS j FROM (SELECT DISTINCT doc_id, m, i FROM hits)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id),
verdicts AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
  FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN its USING (doc_id))
SELECT * FROM verdicts
"""


@query("op4_benchmark_overlap", OP4_SQL.replace("{docs}", "documents"))
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep={"doc_id": "doc_id"})
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontaminate.is_contaminated().alias("contaminated"))


@query("op5_token_secrets")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_secrets.secret_spans(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return found.select("doc_id", *[of(k).alias(f"n_{k}") for k in token_secrets.KINDS[:3]],
                        F.sha2(text(F.filter("spans", lambda x: x["kind"] != "random")), 256).alias("base_sha256"),
                        text(F.col("spans")).alias("spans"), of("random").alias("n_random"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, i, w[i] AS x, CASE WHEN i > 1 THEN w[i - 1] END AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
uni AS (SELECT x, count(*) AS c FROM t GROUP BY x),
bi AS (SELECT h, x, count(*) AS c2 FROM t WHERE h IS NOT NULL GROUP BY h, x),
n AS (SELECT count(*) AS total FROM t),
s AS (
  SELECT doc_id, CASE WHEN c2 >= 2 THEN ln(c2 / hc.c) WHEN h IS NOT NULL THEN ln(0.4 * u.c / total) ELSE ln(u.c / total) END AS v,
    h IS NOT NULL AND c2 < 2 AS backed
  FROM t JOIN uni u USING (x) LEFT JOIN bi USING (h, x) LEFT JOIN uni hc ON hc.x = t.h, n)
SELECT doc_id, len(w)::BIGINT AS n_tokens, coalesce(n_backoff, 0)::BIGINT AS n_backoff, round(score, 6) AS score
FROM d LEFT JOIN (SELECT doc_id, sum(backed::INT) AS n_backoff, avg(v) AS score FROM s GROUP BY doc_id) USING (doc_id)
"""


@query("op6_backoff_scores", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = backoff_lm.score(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_tokens", "n_backoff", F.round("score", 6).alias("score"))


@query("op7_suffix_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


#: Shingles of the contract of this query; the operator's own default is five words.
OP8_WORDS = 2


@query("op8_setsketch_groups")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = setsketch.near_duplicates(table(spark, sf_dir, "documents"), k=OP8_WORDS)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("root_id").alias("component_id"),
                      F.col("id").eqNullSafe(F.col("root_id")).alias("kept"))
