"""Result-table queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..fixtures import clean_events, table
from ..functions.rank_select import rows_at
from ..operators import views as V
from ..ml.train import run_training, save_training
from ..operators.diff import updated_cells
from ..plans.cleaning import CleanSpec, run_cleaning
from ..session import ensure_checkpoint_dir
from ..sources.registry import list_models
from .cleaning import CLEAN_RUN_SPEC, CLEAN_RUN_SQL
from . import query, r6

SCORED_SQL = """scored AS (SELECT event_id AS idx, event_type AS prediction,
  value / (SELECT max(value) FROM events) AS confidence FROM events)"""


def _scored(spark, sf):
    ev = table(spark, sf, "events")
    mx = ev.agg(F.max("value")).collect()[0][0]
    return ev.select(F.col("event_id").alias("idx"), F.col("event_type").alias("prediction"),
                     (F.col("value") / F.lit(mx)).alias("confidence"))


@query("table_filter_sort_page", """
SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer
WHERE contains(lower(coalesce(c_mktsegment, '')), 'build') AND contains(lower(coalesce(CAST(c_nationkey AS VARCHAR), '')), '1')
ORDER BY c_acctbal DESC NULLS LAST, c_custkey OFFSET 20 LIMIT 20""")
def q_table_filter_sort_page(spark, sf):
    df = table(spark, sf, "customer")
    f = V.contains_filter(df, {"c_mktsegment": "BUILD", "c_nationkey": "1"})
    return V.page(f, [V.Key("c_acctbal", ascending=False), "c_custkey"], 1, 20) \
        .select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")


@query("page_deep_desc", """
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber
OFFSET (SELECT count(*) // 100 - 3 FROM lineitem) * 50 LIMIT 50""")
def q_page_deep_desc(spark, sf):
    """A page in the middle of the table, in descending order."""
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    order = [V.Key("l_extendedprice", ascending=False), "l_orderkey", "l_linenumber"]
    return V.page(df, order, df.count() // 100 - 3, 50)


@query("page_by_counts", """
SELECT l_orderkey, l_linenumber, l_returnflag, l_extendedprice FROM lineitem
ORDER BY l_returnflag DESC NULLS LAST, l_linenumber, l_extendedprice, l_orderkey
OFFSET (SELECT count(*) // 2 FROM lineitem) LIMIT 50""")
def q_page_by_counts(spark, sf):
    """V3: the page is found by counting key ranges; each flag and line number holds a large share of the rows."""
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    order = [V.Key("l_returnflag", ascending=False), "l_linenumber", "l_extendedprice", "l_orderkey"]
    return rows_at(df, order, df.count() // 2, 50, few=500)


@query("table_sort", """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice ASC NULLS FIRST, o_orderkey""")
def q_table_sort(spark, sf):
    return V.sort_by(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", True,
                     ["o_orderkey"])


@query("prediction_search", "WITH " + SCORED_SQL + """
SELECT idx, prediction, round(confidence, 6) AS confidence,
  CASE WHEN confidence * 100 >= 80 THEN 'high' WHEN confidence * 100 >= 60 THEN 'medium' ELSE 'low' END AS band
FROM scored WHERE contains(lower(prediction), 'ic') OR contains(CAST(idx + 1 AS VARCHAR), 'ic')""")
def q_prediction_search(spark, sf):
    s = V.search_predictions(_scored(spark, sf), "IC", "prediction", "idx")
    return s.select("idx", "prediction", r6(F.col("confidence")).alias("confidence"),
                    V.confidence_band(F.col("confidence")).alias("band"))


@query("prediction_band_page", "WITH " + SCORED_SQL + """
SELECT idx, prediction, round(confidence, 6) AS confidence FROM scored
WHERE confidence * 100 >= 60 AND confidence * 100 < 80 ORDER BY confidence DESC, idx OFFSET 10 LIMIT 10""")
def q_prediction_band_page(spark, sf):
    s = _scored(spark, sf)
    s = s.where(V.confidence_band(F.col("confidence")) == "medium")
    return V.page(s, [V.Key("confidence", ascending=False), "idx"], 1, 10) \
        .select("idx", "prediction", r6(F.col("confidence")).alias("confidence"))


@query("confidence_histogram", "WITH " + SCORED_SQL + """
SELECT 0 AS position, '90-100%' AS range, count(*) FILTER (WHERE confidence * 100 >= 90) AS count FROM scored
UNION ALL SELECT 1, '80-90%', count(*) FILTER (WHERE confidence * 100 >= 80 AND confidence * 100 < 90) FROM scored
UNION ALL SELECT 2, '70-80%', count(*) FILTER (WHERE confidence * 100 >= 70 AND confidence * 100 < 80) FROM scored
UNION ALL SELECT 3, '60-70%', count(*) FILTER (WHERE confidence * 100 >= 60 AND confidence * 100 < 70) FROM scored
UNION ALL SELECT 4, 'Below 60%', count(*) FILTER (WHERE confidence * 100 < 60) FROM scored""")
def q_confidence_histogram(spark, sf):
    return V.confidence_histogram(_scored(spark, sf), "confidence")


@query("class_top10", """
SELECT o_orderpriority AS value, count(*) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM orders), 6) AS percentage
FROM orders GROUP BY 1 ORDER BY count DESC, value LIMIT 10""")
def q_class_top10(spark, sf):
    from ..operators.profile import class_distribution
    return class_distribution(table(spark, sf, "orders"), "o_orderpriority", 10) \
        .withColumn("percentage", r6(F.col("percentage")))


@query("prediction_summary", "WITH " + SCORED_SQL + """
SELECT round(avg(confidence) * 100, 6) AS avg_confidence, round(max(confidence) * 100, 6) AS max_confidence,
  round(min(confidence) * 100, 6) AS min_confidence, count(DISTINCT prediction) AS unique_classes,
  count(*) AS total_predictions FROM scored""")
def q_prediction_summary(spark, sf):
    s = V.prediction_summary(_scored(spark, sf), "prediction", "confidence", "classification")
    return s.select(*[r6(F.col(c)).alias(c) if "confidence" in c else F.col(c) for c in s.columns])


@query("prediction_summary_regression", """
SELECT round(avg(o_totalprice), 6) AS avg_value, max(o_totalprice) AS max_value, min(o_totalprice) AS min_value,
  count(*) AS total_predictions FROM orders""")
def q_prediction_summary_regression(spark, sf):
    s = V.prediction_summary(table(spark, sf, "orders"), "o_totalprice", None, "regression")
    return s.withColumn("avg_value", r6(F.col("avg_value")))


@query("prediction_export", "WITH " + SCORED_SQL + """
SELECT e.event_id, e.user_id, s.prediction, round(s.confidence, 4) AS confidence
FROM events e JOIN scored s ON e.event_id = s.idx""")
def q_prediction_export(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id")
    joined = ev.join(_scored(spark, sf), ev.event_id == F.col("idx")).drop("idx")
    return V.export_predictions(joined)


@query("updated_cell_flags", CLEAN_RUN_SQL + """,
j AS (SELECT o.*, c.event_type AS a3, c.value AS a4 FROM o JOIN clean_events c ON c.row_id = o.row_id)
SELECT row_id, list_sort(list_filter([CASE WHEN a3 IS DISTINCT FROM event_type THEN 'event_type' END,
  CASE WHEN a4 IS DISTINCT FROM value THEN 'value' END], lambda x: x IS NOT NULL)) AS updated_columns FROM j""")
def q_updated_cell_flags(spark, sf):
    original = clean_events(spark, sf)
    res = run_cleaning(original, CleanSpec(**CLEAN_RUN_SPEC))
    cleaned = res.output
    return V.flag_updated_cells(cleaned.select("row_id"), updated_cells(original, cleaned, "row_id"), "row_id")


def _trained(spark, sf):
    """Two models over the labelled documents, saved and listed."""
    base = f"{ensure_checkpoint_dir(spark)}/leaderboard-{uuid.uuid4().hex[:8]}"
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source") \
        .join(table(spark, sf, "labels").select("doc_id", "quality", "toxic"), "doc_id")
    for target in ("quality", "toxic"):
        res = run_training(docs.drop("toxic" if target == "quality" else "quality"), target, "doc_id", ["logistic_regression"])
        save_training(res, base, filename="documents.parquet")
    return list_models(spark, base)


@query("leaderboard")
def q_leaderboard(spark, sf):
    best = V.leaderboard(_trained(spark, sf), "classification", "Linear Models", "accuracy")
    return best.select("problem_type", "target_column", "best_model", "filename", r6(F.col("score")).alias("score"))


@query("model_groups", """
WITH j AS (SELECT l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id))
SELECT 'documents.parquet' AS file, 'quality' AS target, 1::BIGINT AS n, count(quality) AS rows FROM j
UNION ALL SELECT 'documents.parquet', 'toxic', 1, count(toxic) FROM j""")
def q_model_groups(spark, sf):
    models = _trained(spark, sf)
    rows = models.groupBy(F.col("target_column").alias("target")).agg(F.max("dataset_info.rows").alias("rows"))
    return V.group_models(models).join(rows, "target").select("file", "target", "n", "rows")


@query("top_models")
def q_top_models(spark, sf):
    return V.top_k(_trained(spark, sf), "score", 3, "target_column").select("target_column", "best_model", r6(F.col("score")).alias("score"))


EXPECTED = ["c_custkey", "c_name", "c_acctbal", "c_phone", "c_comment"]


@query("schema_check", """
SELECT unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment', 'c_phone', 'c_comment']) AS "column",
  unnest(['expected', 'expected', 'extra', 'expected', 'extra', 'missing', 'missing']) AS status,
  unnest([count(c_custkey), count(c_name), count(c_nationkey), count(c_acctbal), count(c_mktsegment), NULL, NULL]) AS present FROM customer""")
def q_schema_check(spark, sf):
    return V.schema_report(table(spark, sf, "customer"), EXPECTED)
