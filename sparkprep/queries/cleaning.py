"""Cleaning queries (C1-C14, C15-C18) over ``dirty_events`` and driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import clean_events, clean_events_sql, dirty_events, table
from ..functions.missing import standardize_missing
from ..operators.clean import (DropColumns, FillNulls, RemoveDuplicates, RemoveNulls, RemoveOutliers,
                               drop_identifier_columns)
from ..operators.smart import clip_to_iqr, smart_imputation, smart_outliers, smart_scaling
from ..plans.cleaning import CleanSpec, run_cleaning
from . import query, r6

EV_COLS = ["row_id", "event_id", "user_id", "event_type", "value", "props"]
EV_SQL = "row_id, event_id, user_id, event_type, value, props"
W = "WITH " + clean_events_sql()


def _ev(df):
    return df.select(*[c for c in EV_COLS if c in df.columns])


@query("standardize_missing", W + f"\nSELECT {EV_SQL} FROM clean_events")
def q_standardize_missing(spark, sf):
    return _ev(standardize_missing(dirty_events(spark, sf)))


@query("dedupe_subset", W + f"""
SELECT {EV_SQL} FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY row_id) AS rn FROM clean_events)
WHERE rn = 1""")
def q_dedupe_subset(spark, sf):
    df = clean_events(spark, sf)
    return _ev(RemoveDuplicates(["user_id", "event_type"], "row_id").fit(df).transform(df))


@query("dedupe_all", W + f"""
SELECT min(row_id) AS row_id, event_id, user_id, event_type, value, props
FROM clean_events GROUP BY event_id, ts, user_id, event_type, value, props""")
def q_dedupe_all(spark, sf):
    df = clean_events(spark, sf)
    return _ev(RemoveDuplicates(None, "row_id").fit(df).transform(df))


@query("drop_nulls", W + f"\nSELECT {EV_SQL} FROM clean_events "
       "WHERE event_type IS NOT NULL AND value IS NOT NULL AND props IS NOT NULL")
def q_drop_nulls(spark, sf):
    df = clean_events(spark, sf)
    return _ev(RemoveNulls().fit(df).transform(df))


@query("drop_nulls_subset", W + f"\nSELECT {EV_SQL} FROM clean_events WHERE value IS NOT NULL")
def q_drop_nulls_subset(spark, sf):
    df = clean_events(spark, sf)
    return _ev(RemoveNulls(["value", "not_a_column"]).fit(df).transform(df))


@query("fill_mean", W + """
SELECT row_id, event_id, round(coalesce(value, (SELECT avg(value) FROM clean_events)), 6) AS value
FROM clean_events""")
def q_fill_mean(spark, sf):
    df = clean_events(spark, sf)
    out = FillNulls({"value": {"strategy": "mean"}}).fit(df).transform(df)
    return out.select("row_id", "event_id", r6(F.col("value")).alias("value"))


@query("fill_mean_nan", """
WITH h AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'nan'::DOUBLE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events),
p AS (SELECT avg(value) AS mean FROM h WHERE NOT isnan(value))
SELECT event_id, round(CASE WHEN value IS NULL OR isnan(value) THEN mean ELSE value END, 6) AS value FROM h, p""")
def q_fill_mean_nan(spark, sf):
    """NaN counts as missing in the fit as well, without C1 before it."""
    h = table(spark, sf, "events").selectExpr(
        "event_id", "CASE WHEN event_id % 9 = 0 THEN double('NaN') WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value")
    out = FillNulls({"value": {"strategy": "mean"}}).fit(h).transform(h)
    return out.select("event_id", r6(F.col("value")).alias("value"))


@query("fill_median", W + """
SELECT row_id, event_id, round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM clean_events)), 6) AS value
FROM clean_events""")
def q_fill_median(spark, sf):
    df = clean_events(spark, sf)
    out = FillNulls({"value": {"strategy": "median"}}).fit(df).transform(df)
    return out.select("row_id", "event_id", r6(F.col("value")).alias("value"))


@query("fill_mode", W + """
SELECT row_id, event_id,
  coalesce(event_type, (SELECT event_type FROM clean_events WHERE event_type IS NOT NULL
                        GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1)) AS event_type,
  coalesce(value, (SELECT value FROM clean_events WHERE value IS NOT NULL
                   GROUP BY value ORDER BY count(*) DESC, value LIMIT 1)) AS value
FROM clean_events""")
def q_fill_mode(spark, sf):
    df = clean_events(spark, sf)
    out = FillNulls({"event_type": {"strategy": "mode"}, "value": {"strategy": "mode"}}).fit(df).transform(df)
    return out.select("row_id", "event_id", "event_type", "value")


@query("fill_custom", W + """
SELECT row_id, event_id, coalesce(event_type, 'unknown') AS event_type, coalesce(value, 0.0) AS value
FROM clean_events""")
def q_fill_custom(spark, sf):
    df = clean_events(spark, sf)
    spec = {"event_type": {"strategy": "custom", "value": "unknown"},
            "value": {"strategy": "custom", "value": "0"}, "missing_column": {"strategy": "custom", "value": 1}}
    out = FillNulls(spec).fit(df).transform(df)
    return out.select("row_id", "event_id", "event_type", "value")


@query("drop_columns", W + "\nSELECT row_id, event_id, user_id, event_type, value FROM clean_events")
def q_drop_columns(spark, sf):
    df = clean_events(spark, sf)
    return DropColumns(["ts", "props", "no_such_column"]).fit(df).transform(df)


@query("outliers_iqr", W + """,
b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM clean_events)
SELECT row_id, event_id, value FROM clean_events, b
WHERE value IS NULL OR value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""")
def q_outliers_iqr(spark, sf):
    df = clean_events(spark, sf)
    return RemoveOutliers(["value"], "iqr", 1.5).fit(df).transform(df).select("row_id", "event_id", "value")


@query("outliers_iqr_table", """
WITH b AS (SELECT quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.75) AS q3 FROM documents)
SELECT doc_id, n_chars, lang FROM documents, b
WHERE n_chars BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""")
def q_outliers_iqr_table(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    return RemoveOutliers(None, "iqr", 1.5, exclude=("doc_id",)).fit(df).transform(df)


@query("outliers_zscore", W + """,
b AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM clean_events)
SELECT row_id, event_id, value FROM clean_events, b
WHERE value IS NULL OR abs((value - m) / s) <= 2.0""")
def q_outliers_zscore(spark, sf):
    df = clean_events(spark, sf)
    return RemoveOutliers(["value"], "zscore", 2.0).fit(df).transform(df).select("row_id", "event_id", "value")


@query("outliers_unsupported", W + "\nSELECT row_id, event_id, value FROM clean_events")
def q_outliers_unsupported(spark, sf):
    df = clean_events(spark, sf)
    return RemoveOutliers(["value"], "isolation", 1.5).fit(df).transform(df).select("row_id", "event_id", "value")


@query("clip_iqr", W + """,
b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM clean_events)
SELECT row_id, round(CASE WHEN value IS NULL THEN NULL
  ELSE greatest(q1 - 1.5 * (q3 - q1), least(q3 + 1.5 * (q3 - q1), value)) END, 6) AS value
FROM clean_events, b""")
def q_clip_iqr(spark, sf):
    df = clean_events(spark, sf)
    return clip_to_iqr(df, ["value"]).select("row_id", r6(F.col("value")).alias("value"))


CLEAN_RUN_SPEC = dict(remove_duplicates=True, remove_nulls=True, null_columns=["user_id"],
                      fill_nulls={"value": {"strategy": "median"}, "event_type": {"strategy": "mode"}},
                      drop_columns=["props", "ts"], remove_outliers=True, outlier_columns=["value"],
                      row_key="row_id")

CLEAN_RUN_SQL = W + """,
d AS (SELECT min(row_id) AS row_id, event_id, user_id, event_type, value, props
      FROM clean_events GROUP BY event_id, ts, user_id, event_type, value, props),
n AS (SELECT * FROM d WHERE user_id IS NOT NULL),
f AS (SELECT row_id, event_id, user_id,
        coalesce(event_type, (SELECT event_type FROM n WHERE event_type IS NOT NULL GROUP BY event_type
                              ORDER BY count(*) DESC, event_type LIMIT 1)) AS event_type,
        coalesce(value, (SELECT quantile_cont(value, 0.5) FROM n)) AS value FROM n),
b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM f),
o AS (SELECT f.* FROM f, b WHERE value IS NULL OR value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))"""


@query("clean_run", CLEAN_RUN_SQL + "\nSELECT row_id, event_id, user_id, event_type, round(value, 6) AS value FROM o")
def q_clean_run(spark, sf):
    res = run_cleaning(clean_events(spark, sf), CleanSpec(**CLEAN_RUN_SPEC))
    return res.output.select("row_id", "event_id", "user_id", "event_type", r6(F.col("value")).alias("value"))


@query("change_log", CLEAN_RUN_SQL + """,
c AS (SELECT 0 AS step, 'input' AS operation, (SELECT count(*) FROM clean_events) AS rows_after, 7 AS columns_after
      UNION ALL SELECT 1, 'remove_duplicates', (SELECT count(*) FROM d), 7
      UNION ALL SELECT 2, 'remove_nulls', (SELECT count(*) FROM n), 7
      UNION ALL SELECT 3, 'fill_nulls', (SELECT count(*) FROM f), 7
      UNION ALL SELECT 4, 'drop_columns', (SELECT count(*) FROM f), 5
      UNION ALL SELECT 5, 'remove_outliers', (SELECT count(*) FROM o), 5)
SELECT step, operation, rows_before, rows_after, rows_before - rows_after AS rows_removed, columns_after FROM (
  SELECT *, lag(rows_after) OVER (ORDER BY step) AS rows_before FROM c) WHERE step > 0""")
def q_change_log(spark, sf):
    res = run_cleaning(clean_events(spark, sf), CleanSpec(**CLEAN_RUN_SPEC))
    return res.change_log()


@query("change_log_details", CLEAN_RUN_SQL + """
SELECT 1 AS step, 'remove_duplicates' AS operation, '*' AS "column", NULL::VARCHAR AS strategy, NULL::VARCHAR AS value,
  NULL::DOUBLE AS lower, NULL::DOUBLE AS upper, NULL::VARCHAR AS method, NULL::DOUBLE AS factor
UNION ALL SELECT 2, 'remove_nulls', 'user_id', NULL, NULL, NULL, NULL, NULL, NULL
UNION ALL SELECT 3, 'fill_nulls', 'event_type', 'mode', (SELECT event_type FROM n WHERE event_type IS NOT NULL GROUP BY event_type
  ORDER BY count(*) DESC, event_type LIMIT 1), NULL, NULL, NULL, NULL
UNION ALL SELECT 3, 'fill_nulls', 'value', 'median', (SELECT quantile_cont(value, 0.5) FROM n)::VARCHAR, NULL, NULL, NULL, NULL
UNION ALL SELECT 4, 'drop_columns', unnest(['props', 'ts']), NULL, NULL, NULL, NULL, NULL, NULL
UNION ALL SELECT 5, 'remove_outliers', 'value', NULL, NULL, round(q1 - 1.5 * (q3 - q1), 6), round(q3 + 1.5 * (q3 - q1), 6), 'IQR', 1.5 FROM b""")
def q_change_log_details(spark, sf):
    res = run_cleaning(clean_events(spark, sf), CleanSpec(**CLEAN_RUN_SPEC))
    return res.details_frame(spark).withColumns({c: r6(F.col(c)) for c in ("lower", "upper")})


@query("smart_scale_skewed", """
WITH d AS (SELECT o_orderkey, o_totalprice * o_totalprice * o_totalprice / 1e12 AS v FROM orders),
s AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.75) AS q3, skewness(v) AS sk FROM d)
SELECT o_orderkey, round((v - med) / (q3 - q1), 6) AS v FROM d, s WHERE abs(sk) > 1""")
def q_smart_scale_skewed(spark, sf):
    """C18 on a skewed column: the robust branch."""
    df = table(spark, sf, "orders").selectExpr("o_orderkey", "o_totalprice * o_totalprice * o_totalprice / 1e12D AS v")
    return smart_scaling(df, exclude=("o_orderkey",)).select("o_orderkey", r6(F.col("v")).alias("v"))


@query("drop_id_columns", "SELECT c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def q_drop_id_columns(spark, sf):
    df = table(spark, sf, "customer").withColumnRenamed("c_custkey", "ID")
    return drop_identifier_columns(df)


@query("smart_impute", W + """,
s AS (SELECT avg(value) AS mean FROM clean_events)
SELECT row_id, event_id, round(coalesce(value, mean), 6) AS value,
  CAST(event_type IS NOT DISTINCT FROM 'click' AS TINYINT) AS event_type_click,
  CAST(event_type IS NOT DISTINCT FROM 'error' AS TINYINT) AS event_type_error,
  CAST(event_type IS NOT DISTINCT FROM 'purchase' AS TINYINT) AS event_type_purchase,
  CAST(event_type IS NOT DISTINCT FROM 'signup' AS TINYINT) AS event_type_signup,
  CAST(event_type IS NOT DISTINCT FROM 'view' AS TINYINT) AS event_type_view,
  CAST(event_type IS NULL AS TINYINT) AS event_type_nan
FROM clean_events, s""")
def q_smart_impute(spark, sf):
    df = clean_events(spark, sf).select("row_id", "event_id", "event_type", "value")
    out = smart_imputation(df, exclude=("row_id", "event_id"), measures=("value",))
    return out.withColumn("value", r6(F.col("value")))


@query("smart_outliers", """
WITH b AS (SELECT quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.75) AS q3, count(*) AS n FROM documents),
p AS (SELECT 100.0 * count(*) FILTER (WHERE n_chars < q1 - 1.5 * (q3 - q1) OR n_chars > q3 + 1.5 * (q3 - q1)) / max(n) AS pct
      FROM documents, b)
SELECT doc_id, round(CASE WHEN pct > 20 THEN (n_chars - (SELECT quantile_cont(n_chars, 0.5) FROM documents)) / (q3 - q1)
                    WHEN pct > 5 THEN greatest(q1 - 1.5 * (q3 - q1), least(q3 + 1.5 * (q3 - q1), n_chars))
                    ELSE n_chars END, 6) AS n_chars
FROM documents, b, p
WHERE pct > 5 OR n_chars BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""")
def q_smart_outliers(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "n_chars")
    out = smart_outliers(df, exclude=("doc_id",))
    return out.select("doc_id", r6(F.col("n_chars").cast("double")).alias("n_chars"))


@query("smart_scale", """
WITH s AS (SELECT skewness(o_totalprice) AS sk, avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS sd,
                  quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS med,
                  quantile_cont(o_totalprice, 0.75) AS q3 FROM orders)
SELECT o_orderkey, round(CASE WHEN abs(sk) > 1 THEN (o_totalprice - med) / (q3 - q1)
                         ELSE (o_totalprice - m) / sd END, 6) AS o_totalprice
FROM orders, s""")
def q_smart_scale(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    out = smart_scaling(df, exclude=("o_orderkey",))
    return out.select("o_orderkey", r6(F.col("o_totalprice")).alias("o_totalprice"))
