"""Profiling and quality queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..fixtures import clean_events, clean_events_sql, table
from ..functions import sketches
from ..functions.quantiles import exact_quantiles
from ..operators.profile import (class_distribution, column_insights, column_profile, dataset_preview, duplicate_count,
                                 first_values, missing_table, outlier_fences, outlier_table, preview_records,
                                 quality_score_table, target_analysis, target_classes, type_table)
from ..session import ensure_checkpoint_dir
from . import query, r6

W = "WITH " + clean_events_sql()
EV = ["event_id", "user_id", "event_type", "value", "props"]


def _profile_sql() -> str:
    cols = [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"),
            ("c_mktsegment", "string")]
    parts = [f"""SELECT '{c}' AS "column", '{t}' AS dtype, count(*) FILTER (WHERE {c} IS NULL) AS null_count,
  CAST(arg_min({c}, c_custkey) FILTER (WHERE {c} IS NOT NULL) AS VARCHAR) AS sample,
  count(DISTINCT {c}) AS distinct_count FROM customer""" for c, t in cols]
    return "\nUNION ALL ".join(parts)


@query("profile_columns", _profile_sql())
def q_profile_columns(spark, sf):
    return column_profile(table(spark, sf, "customer"), row_key="c_custkey")


@query("preview_records", """
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer ORDER BY c_custkey LIMIT 1000""")
def q_preview_records(spark, sf):
    return preview_records(table(spark, sf, "customer"), "c_custkey", 1000)


def _missing_sql() -> str:
    parts = [f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} IS NULL) AS count,
  round(count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*), 6) AS percentage FROM clean_events""" for c in EV]
    return W + ", m AS (" + "\nUNION ALL ".join(parts) + """)
SELECT "column", count, percentage,
  CASE WHEN percentage > 50 THEN 'critical' WHEN percentage > 10 THEN 'moderate' ELSE 'minor' END AS type
FROM m WHERE count > 0"""


def _ev(spark, sf):
    return clean_events(spark, sf).select(*EV)


@query("quality_missing", _missing_sql())
def q_quality_missing(spark, sf):
    return missing_table(_ev(spark, sf)).withColumn("percentage", r6(F.col("percentage")))


@query("duplicate_count", W + """
SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows FROM (
  SELECT count(*) AS n FROM clean_events GROUP BY event_id, user_id, event_type, value, props)""")
def q_duplicate_count(spark, sf):
    return duplicate_count(_ev(spark, sf))


def _types_sql() -> str:
    types = {"event_id": "bigint", "user_id": "bigint", "event_type": "string", "value": "double",
             "props": "string"}
    parts = [f"""SELECT '{c}' AS "column", '{t}' AS type, count(DISTINCT {c}) AS unique_values,
  {'true' if t == 'string' else 'false'} OR count(DISTINCT {c}) < count(*) * 0.1 AS is_categorical
  FROM clean_events""" for c, t in types.items()]
    return W + "\n" + "\nUNION ALL ".join(parts)


@query("type_report", _types_sql())
def q_type_report(spark, sf):
    return type_table(_ev(spark, sf))


OUTLIER_SQL = W + """,
f AS (SELECT 'event_id' AS c, quantile_cont(event_id, 0.25) AS q1, quantile_cont(event_id, 0.75) AS q3 FROM clean_events
      UNION ALL SELECT 'user_id', quantile_cont(user_id, 0.25), quantile_cont(user_id, 0.75) FROM clean_events
      UNION ALL SELECT 'value', quantile_cont(value, 0.25), quantile_cont(value, 0.75) FROM clean_events),
b AS (SELECT c, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM f),
o AS (SELECT 'event_id' AS "column", count(*) FILTER (WHERE event_id < (SELECT lo FROM b WHERE c = 'event_id')
        OR event_id > (SELECT hi FROM b WHERE c = 'event_id')) AS count, count(*) AS n FROM clean_events
      UNION ALL SELECT 'user_id', count(*) FILTER (WHERE user_id < (SELECT lo FROM b WHERE c = 'user_id')
        OR user_id > (SELECT hi FROM b WHERE c = 'user_id')), count(*) FROM clean_events
      UNION ALL SELECT 'value', count(*) FILTER (WHERE value < (SELECT lo FROM b WHERE c = 'value')
        OR value > (SELECT hi FROM b WHERE c = 'value')), count(*) FROM clean_events)"""


@query("quality_outliers", OUTLIER_SQL + """
SELECT "column", count, round(count * 100.0 / n, 6) AS percentage, round(lo, 6) AS lower_bound,
       round(hi, 6) AS upper_bound FROM o JOIN b ON o."column" = b.c""")
def q_quality_outliers(spark, sf):
    df = _ev(spark, sf)
    t = outlier_table(df, outlier_fences(df))
    return t.select("column", "count", *[r6(F.col(c)).alias(c) for c in ("percentage", "lower_bound", "upper_bound")])


@query("quality_score", OUTLIER_SQL.replace("WITH ", "WITH ", 1) + """,
m AS (SELECT (count(*) - count(event_type)) * 100.0 / count(*) + (count(*) - count(value)) * 100.0 / count(*)
           + (count(*) - count(props)) * 100.0 / count(*) AS mp, count(*) AS n FROM clean_events),
d AS (SELECT coalesce(sum(k - 1), 0) AS dups FROM (SELECT count(*) AS k FROM clean_events
      GROUP BY event_id, user_id, event_type, value, props)),
s AS (SELECT sum(count * 100.0 / n) AS op, count(*) AS oc FROM o)
SELECT round(greatest(0, 100 - mp * 0.5 - dups * 100.0 / m.n - op * 0.3), 6) AS quality_score,
       CAST(dups AS BIGINT) AS duplicate_rows,
       list_filter([CASE WHEN mp > 0 THEN 'Missing values detected - applying smart imputation' END,
                    CASE WHEN dups > 0 THEN 'Found ' || CAST(CAST(dups AS BIGINT) AS VARCHAR) || ' duplicate rows - removing duplicates' END,
                    CASE WHEN oc > 0 THEN 'Outliers detected - applying robust outlier handling' END],
                   lambda x: x IS NOT NULL) AS recommendations
FROM m, d, s""")
def q_quality_score(spark, sf):
    df = _ev(spark, sf)
    t = quality_score_table(df, outlier_fences(df))
    return t.withColumn("quality_score", r6(F.col("quality_score")))


def _insight_sql() -> str:
    cols = [("c_custkey", "bigint", True), ("c_name", "string", False), ("c_nationkey", "int", True),
            ("c_acctbal", "double", True), ("c_mktsegment", "string", False)]
    parts = []
    for c, t, num in cols:
        stats = (f"round(min({c}), 6), round(max({c}), 6), round(avg({c}), 6), round(stddev_samp({c}), 6)" if num
                 else "NULL, NULL, NULL, NULL")
        parts.append(f"""SELECT '{c}' AS name, '{t}' AS dtype, count(DISTINCT {c}) AS cardinality,
  count(*) FILTER (WHERE {c} IS NULL) AS missing_count,
  CAST(100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*) AS DOUBLE) AS missing_percentage, {str(num).lower()} AS is_numeric,
  {str(not num).lower()} AS is_categorical, false AS is_datetime, {str(not num).lower()} AS is_text,
  {stats} FROM customer""")
    return "SELECT name, dtype, cardinality, missing_count, missing_percentage, is_numeric, is_categorical, " \
        "is_datetime, is_text, CAST(c10 AS DOUBLE) AS min_value, CAST(c11 AS DOUBLE) AS max_value, " \
        "CAST(c12 AS DOUBLE) AS mean_value, CAST(c13 AS DOUBLE) AS std_value FROM (" + \
        "\nUNION ALL ".join(parts).replace("round(min(", "round(min(", 1) + \
        ") t(name, dtype, cardinality, missing_count, missing_percentage, is_numeric, is_categorical, is_datetime, " \
        "is_text, c10, c11, c12, c13)"


@query("column_insight", _insight_sql())
def q_column_insight(spark, sf):
    t = column_insights(table(spark, sf, "customer"))
    return t.select(*[r6(F.col(c)).alias(c) if c.endswith("_value") else F.col(c) for c in t.columns])


@query("first_values", W + """
SELECT event_type AS value, min(row_id) AS _first FROM clean_events WHERE event_type IS NOT NULL
GROUP BY event_type ORDER BY _first LIMIT 10""")
def q_first_values(spark, sf):
    return first_values(clean_events(spark, sf), "event_type", "row_id", 10)


@query("target_analysis", """
SELECT 'l_extendedprice' AS column_name, 'double' AS dtype, true AS is_numeric, false AS is_categorical,
  false AS is_boolean, count(l_extendedprice) AS total_samples, count(DISTINCT l_extendedprice) AS unique_values,
  round(count(DISTINCT l_extendedprice) / count(l_extendedprice), 6) AS unique_ratio,
  count(*) FILTER (WHERE l_extendedprice IS NULL) AS null_count,
  round(CAST(100.0 * count(*) FILTER (WHERE l_extendedprice IS NULL) / count(*) AS DOUBLE), 6) AS null_percentage,
  round(min(l_extendedprice), 6) AS min_value, round(max(l_extendedprice), 6) AS max_value,
  round(avg(l_extendedprice), 6) AS mean_value, round(stddev_samp(l_extendedprice), 6) AS std_value,
  round(quantile_cont(l_extendedprice, 0.5), 6) AS median_value
FROM lineitem""")
def q_target_analysis(spark, sf):
    t = target_analysis(table(spark, sf, "lineitem"), "l_extendedprice")
    return t.select(*[r6(F.col(c)).alias(c) if c.endswith(("_value", "_ratio", "_percentage")) else F.col(c)
                      for c in t.columns])


@query("target_analysis_binary", """
SELECT 'quality' AS column_name, 'int' AS dtype, true AS is_numeric, false AS is_categorical, true AS is_boolean,
  count(quality) AS total_samples, count(DISTINCT quality) AS unique_values,
  round(count(DISTINCT quality) / count(quality), 6) AS unique_ratio,
  count(*) FILTER (WHERE quality IS NULL) AS null_count,
  round(CAST(100.0 * count(*) FILTER (WHERE quality IS NULL) / count(*) AS DOUBLE), 6) AS null_percentage,
  CAST(NULL AS DOUBLE) AS min_value, CAST(NULL AS DOUBLE) AS max_value, CAST(NULL AS DOUBLE) AS mean_value,
  CAST(NULL AS DOUBLE) AS std_value, CAST(NULL AS DOUBLE) AS median_value FROM labels""")
def q_target_analysis_binary(spark, sf):
    t = target_analysis(table(spark, sf, "labels"), "quality")
    return t.select(*[r6(F.col(c)).alias(c) if c.endswith(("_value", "_ratio", "_percentage")) else F.col(c)
                      for c in t.columns])


@query("target_classes", """
SELECT 'lang' AS target, lang AS value, count(*) AS count FROM documents GROUP BY lang
UNION ALL (SELECT 'source', source, count(*) AS c FROM documents GROUP BY source ORDER BY c DESC, source LIMIT 10)""")
def q_target_classes(spark, sf):
    d = table(spark, sf, "documents")
    out = None
    for c in ("lang", "source", "n_chars"):  # the last has too many values for a class table
        t = target_classes(d, c).select(F.lit(c).alias("target"), "value", "count")
        out = t if out is None else out.unionByName(t)
    return out


@query("class_distribution", """
SELECT event_type AS value, count(*) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM events), 6) AS percentage
FROM events GROUP BY event_type ORDER BY count DESC, event_type LIMIT 10""")
def q_class_distribution(spark, sf):
    t = class_distribution(table(spark, sf, "events"), "event_type", 10)
    return t.withColumn("percentage", r6(F.col("percentage")))


SKETCHED = (0.01, 0.25, 0.5, 0.75, 0.99)


@query("quantiles_from_daily_sketches", f"""
SELECT unnest({list(SKETCHED)})::DOUBLE AS p, unnest(quantile_cont(value, {list(SKETCHED)})) AS value FROM events""")
def q_quantiles_from_daily_sketches(spark, sf):
    """Sketches of each day are kept and merged to brackets; the exact quantiles take one scan behind them."""
    events = table(spark, sf, "events").select("ts", "value")
    path = f"{ensure_checkpoint_dir(spark)}/sketches-{uuid.uuid4().hex[:10]}"
    sketches.build(events, ["value"], F.to_date("ts")).write.parquet(path)
    found = exact_quantiles(events, ["value"], SKETCHED, sketches=spark.read.parquet(path))["value"]
    return spark.createDataFrame(list(zip(SKETCHED, found, strict=True)), "p double, value double")


@query("dataset_preview", f"""
WITH p AS ({_profile_sql()})
SELECT *, (SELECT count(*) FROM customer) AS total_rows, least(20, (SELECT count(*) FROM customer)) AS records,
  (SELECT list(c_custkey ORDER BY c_custkey)[20] FROM customer) AS last_key FROM p""")
def q_dataset_preview(spark, sf):
    """The profile, the first records in key order and the number of rows."""
    p = dataset_preview(table(spark, sf, "customer"), "c_custkey", 20)
    rows = [(c["column"], c["dtype"], c["null_count"], c["sample"], c["distinct_count"], p["total_rows"], len(p["records"]),
             p["records"][-1]["c_custkey"]) for c in p["columns"]]
    return spark.createDataFrame(rows, "column string, dtype string, null_count long, sample string, distinct_count long, total_rows long, "
                                       "records long, last_key long")
