"""Feature engineering queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..fixtures import clean_events, clean_events_sql, table
from ..functions.code_table import CodeTable
from ..operators import Binning, Encoding, FeatureCreation, FeatureSelection, Scaling
from ..operators.select import correlation_decisions, correlation_pairs, selection_columns, variance_table
from ..plans.features import FeatureSpec, run_features
from ..session import ensure_checkpoint_dir
from . import query, r6

W = "WITH " + clean_events_sql()


@query("scale_standard", W + """,
s AS (SELECT avg(value) AS m, stddev_pop(value) AS sd FROM clean_events)
SELECT row_id, round((value - m) / sd, 6) AS value FROM clean_events, s""")
def q_scale_standard(spark, sf):
    df = clean_events(spark, sf)
    out = Scaling(["value"], "standard").fit(df).transform(df)
    return out.select("row_id", r6(F.col("value")).alias("value"))


@query("scale_minmax", """
WITH s AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi, min(c_nationkey) AS nlo, max(c_nationkey) AS nhi
           FROM customer)
SELECT c_custkey, round((c_acctbal - lo) / (hi - lo), 6) AS c_acctbal,
       round((c_nationkey - nlo) / (nhi - nlo), 6) AS c_nationkey FROM customer, s""")
def q_scale_minmax(spark, sf):
    df = table(spark, sf, "customer")
    out = Scaling(["c_acctbal", "c_nationkey", "c_mktsegment"], "minmax").fit(df).transform(df)
    return out.select("c_custkey", r6(F.col("c_acctbal")).alias("c_acctbal"),
                      r6(F.col("c_nationkey")).alias("c_nationkey"))


@query("scale_robust", W + """,
s AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med,
             quantile_cont(value, 0.75) AS q3 FROM clean_events)
SELECT row_id, round((value - med) / (q3 - q1), 6) AS value FROM clean_events, s""")
def q_scale_robust(spark, sf):
    df = clean_events(spark, sf)
    out = Scaling(["value"], "robust").fit(df).transform(df)
    return out.select("row_id", r6(F.col("value")).alias("value"))


@query("scale_log", """
SELECT l_orderkey, l_linenumber, round(ln(1 + greatest(l_extendedprice, 0)), 6) AS l_extendedprice,
       round(ln(1 + greatest(l_discount - 0.05, 0)), 6) AS d
FROM lineitem""")
def q_scale_log(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice",
                                             (F.col("l_discount") - 0.05).alias("d"))
    out = Scaling(["l_extendedprice", "d"], "log").fit(df).transform(df)
    return out.select("l_orderkey", "l_linenumber", r6(F.col("l_extendedprice")).alias("l_extendedprice"),
                      r6(F.col("d")).alias("d"))


@query("scale_mixed", """
WITH s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS sd, min(l_tax) AS lo, max(l_tax) AS hi
           FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_quantity - m) / sd, 6) AS l_quantity,
       round((l_tax - lo) / (hi - lo), 6) AS l_tax FROM lineitem, s""")
def q_scale_mixed(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    out = Scaling(["l_quantity", "l_tax"], "standard", {"l_tax": "minmax"}).fit(df).transform(df)
    return out.select("l_orderkey", "l_linenumber", r6(F.col("l_quantity")).alias("l_quantity"),
                      r6(F.col("l_tax")).alias("l_tax"))


SEGMENTS_SQL = """CAST(c_mktsegment IS NOT DISTINCT FROM 'AUTOMOBILE' AS TINYINT) AS "c_mktsegment_AUTOMOBILE",
  CAST(c_mktsegment IS NOT DISTINCT FROM 'BUILDING' AS TINYINT) AS "c_mktsegment_BUILDING",
  CAST(c_mktsegment IS NOT DISTINCT FROM 'FURNITURE' AS TINYINT) AS "c_mktsegment_FURNITURE",
  CAST(c_mktsegment IS NOT DISTINCT FROM 'HOUSEHOLD' AS TINYINT) AS "c_mktsegment_HOUSEHOLD",
  CAST(c_mktsegment IS NOT DISTINCT FROM 'MACHINERY' AS TINYINT) AS "c_mktsegment_MACHINERY"
"""


@query("onehot", f"SELECT c_custkey, c_acctbal,\n  {SEGMENTS_SQL}\nFROM customer")
def q_onehot(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return Encoding(["c_mktsegment"], "one-hot").fit(df).transform(df)


@query("onehot_nulls", W + """
SELECT row_id, CAST(event_type IS NOT DISTINCT FROM 'click' AS TINYINT) AS event_type_click,
  CAST(event_type IS NOT DISTINCT FROM 'error' AS TINYINT) AS event_type_error,
  CAST(event_type IS NOT DISTINCT FROM 'purchase' AS TINYINT) AS event_type_purchase,
  CAST(event_type IS NOT DISTINCT FROM 'signup' AS TINYINT) AS event_type_signup,
  CAST(event_type IS NOT DISTINCT FROM 'view' AS TINYINT) AS event_type_view,
  CAST(event_type IS NULL AS TINYINT) AS _none
FROM clean_events""")
def q_onehot_nulls(spark, sf):
    df = clean_events(spark, sf).select("row_id", "event_type")
    out = Encoding(["event_type"], "one-hot").fit(df).transform(df)
    none = F.when(sum((F.col(c).cast("int") for c in out.columns if c != "row_id"), F.lit(0)) == 0, 1) \
        .otherwise(0).cast("tinyint")
    return out.withColumn("_none", none)


@query("label_encode", """
SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_name) - 1 AS BIGINT) AS c_name,
       CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS BIGINT) AS c_mktsegment FROM customer""")
def q_label_encode(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return Encoding(["c_name", "c_mktsegment"], "label").fit(df).transform(df)


@query("label_encode_nulls", W + """
SELECT row_id, CAST(dense_rank() OVER (ORDER BY coalesce(event_type, 'nan')) - 1 AS BIGINT) AS event_type
FROM clean_events""")
def q_label_encode_nulls(spark, sf):
    df = clean_events(spark, sf).select("row_id", "event_type")
    return Encoding(["event_type"], "label").fit(df).transform(df)


@query("onehot_auto_label", """
SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority || '#' || CAST(o_custkey AS VARCHAR)) - 1
       AS BIGINT) AS k FROM orders""")
def q_onehot_auto_label(spark, sf):
    df = table(spark, sf, "orders").select(
        "o_orderkey", F.concat_ws("#", "o_orderpriority", F.col("o_custkey").cast("string")).alias("k"))
    return Encoding(["k"], "one-hot").fit(df).transform(df)


@query("target_encode", W + """
SELECT row_id, value, round(avg(value) OVER (PARTITION BY event_type), 6) AS event_type_target_encoded
FROM clean_events WHERE event_type IS NOT NULL
UNION ALL SELECT row_id, value, NULL FROM clean_events WHERE event_type IS NULL""")
def q_target_encode(spark, sf):
    df = clean_events(spark, sf).select("row_id", "event_type", "value")
    out = Encoding(["event_type"], "target", target_column="value").fit(df).transform(df)
    return out.select("row_id", "value", r6(F.col("event_type_target_encoded")).alias("event_type_target_encoded"))


@query("target_encode_large", """
SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey_s), 6) AS o_custkey_s_target_encoded
FROM (SELECT o_orderkey, o_totalprice, CAST(o_custkey AS VARCHAR) AS o_custkey_s FROM orders)""")
def q_target_encode_large(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice",
                                           F.col("o_custkey").cast("string").alias("o_custkey_s"))
    out = Encoding(["o_custkey_s"], "target", target_column="o_totalprice").fit(df).transform(df)
    return out.select("o_orderkey", r6(F.col("o_custkey_s_target_encoded")).alias("o_custkey_s_target_encoded"))


def _width_sql(src: str, col: str, key: str) -> str:
    return f"""
WITH s AS (SELECT min({col}) AS lo, max({col}) AS hi FROM {src}),
e AS (SELECT lo, hi, (hi - lo) / 5 AS step FROM s),
x AS (SELECT {key}, {col}, lo - (hi - lo) * 0.001 AS e0, lo + 1 * step AS e1, lo + 2 * step AS e2,
             lo + 3 * step AS e3, lo + 4 * step AS e4, hi AS e5 FROM {src}, e)
SELECT {key}, CASE WHEN {col} IS NULL OR {col} < e0 THEN NULL WHEN {col} <= e1 THEN 0 WHEN {col} <= e2 THEN 1
  WHEN {col} <= e3 THEN 2 WHEN {col} <= e4 THEN 3 WHEN {col} <= e5 THEN 4 END AS {col}_binned FROM x"""


@query("bin_equal_width", _width_sql("customer", "c_acctbal", "c_custkey"))
def q_bin_equal_width(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return Binning(["c_acctbal"], "equal-width", 5).fit(df).transform(df).select("c_custkey", "c_acctbal_binned")


@query("bin_equal_width_nulls", W + _width_sql("clean_events", "value", "row_id").replace("WITH s AS", ", s AS", 1))
def q_bin_equal_width_nulls(spark, sf):
    df = clean_events(spark, sf).select("row_id", "value")
    return Binning(["value"], "equal-width", 5).fit(df).transform(df).select("row_id", "value_binned")


@query("bin_quantile", W + """,
q AS (SELECT quantile_cont(value, [0.0, 0.25, 0.5, 0.75, 1.0]) AS qs FROM clean_events),
e AS (SELECT list_sort(list_distinct(qs)) AS es FROM q)
SELECT row_id, CASE WHEN value IS NULL THEN NULL WHEN value = es[1] THEN 0
  ELSE CAST(len(list_filter(es, lambda v: v < value)) - 1 AS INTEGER) END AS value_binned
FROM clean_events, e""")
def q_bin_quantile(spark, sf):
    df = clean_events(spark, sf).select("row_id", "value")
    return Binning(["value"], "quantile", 4).fit(df).transform(df).select("row_id", "value_binned")


@query("bin_quantile_ties", """
WITH q AS (SELECT quantile_cont(l_quantity, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS qs FROM lineitem),
e AS (SELECT list_sort(list_distinct(qs)) AS es FROM q)
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity = es[1] THEN 0
  ELSE CAST(len(list_filter(es, lambda v: v < l_quantity)) - 1 AS INTEGER) END AS l_quantity_binned
FROM lineitem, e""")
def q_bin_quantile_ties(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return Binning(["l_quantity"], "quantile", 10).fit(df).transform(df) \
        .select("l_orderkey", "l_linenumber", "l_quantity_binned")


@query("polynomial", """
SELECT l_orderkey, l_linenumber, round(l_quantity, 6) AS l_quantity,
       round(l_quantity * l_quantity, 6) AS "l_quantity^2", round(l_quantity * l_quantity * l_quantity, 6) AS "l_quantity^3",
       round(l_discount, 6) AS l_discount, round(l_discount * l_discount, 6) AS "l_discount^2",
       round(l_discount * l_discount * l_discount, 6) AS "l_discount^3" FROM lineitem""")
def q_polynomial(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    out = FeatureCreation(["l_quantity", "l_discount"], "polynomial", degree=3).fit(df).transform(df)
    return out.select("l_orderkey", "l_linenumber",
                      *[r6(F.col(f"`{c}`")).alias(c) for c in out.columns if c not in ("l_orderkey", "l_linenumber")])


@query("datetime_parts", """
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year,
  CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month, CAST(day(o_orderdate) AS INTEGER) AS o_orderdate_day,
  CAST(hour(o_orderdate) AS INTEGER) AS o_orderdate_hour, CAST(minute(o_orderdate) AS INTEGER) AS o_orderdate_minute,
  CAST(second(o_orderdate) AS INTEGER) AS o_orderdate_second FROM orders""")
def q_datetime_parts(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    out = FeatureCreation(["o_orderdate"], "datetime_decomposition").fit(df).transform(df)
    return out.drop("o_orderdate")


@query("datetime_parts_text", """
SELECT event_id, CAST(year(ts) AS INTEGER) AS t_year, CAST(month(ts) AS INTEGER) AS t_month,
  CAST(day(ts) AS INTEGER) AS t_day, CAST(hour(ts) AS INTEGER) AS t_hour, CAST(minute(ts) AS INTEGER) AS t_minute,
  CAST(second(ts) AS INTEGER) AS t_second FROM events WHERE event_id % 3 <> 0
UNION ALL SELECT event_id, NULL, NULL, NULL, NULL, NULL, NULL FROM events WHERE event_id % 3 = 0""")
def q_datetime_parts_text(spark, sf):
    ev = table(spark, sf, "events")
    t = F.when(F.col("event_id") % 3 == 0, F.lit("not a date")) \
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("t")
    df = ev.select("event_id", t)
    return FeatureCreation(["t"], "datetime_decomposition").fit(df).transform(df).drop("t")


def _group_sql(how: str) -> str:
    per = {"sum": "coalesce(sum({v}) OVER w, 0)", "mean": "avg({v}) OVER w", "min": "min({v}) OVER w",
           "max": "max({v}) OVER w", "count": "count({v}) OVER w"}[how]
    a, b = per.format(v="value"), per.format(v="CAST(user_id AS DOUBLE)")
    combine = {"sum": f"coalesce({a}, 0) + coalesce({b}, 0)", "count": f"coalesce({a}, 0) + coalesce({b}, 0)",
               "mean": f"(coalesce({a}, 0) + coalesce({b}, 0)) / nullif(({a} IS NOT NULL)::INT + ({b} IS NOT NULL)::INT, 0)",
               "min": f"least({a}, {b})", "max": f"greatest({a}, {b})"}[how]
    null_val = "0" if how in ("sum", "count") else "NULL"
    return W + f"""
SELECT row_id, round(CAST({combine} AS DOUBLE), 6) AS g FROM clean_events WHERE event_type IS NOT NULL
WINDOW w AS (PARTITION BY event_type)
UNION ALL SELECT row_id, {null_val} FROM clean_events WHERE event_type IS NULL"""


def _group_query(how: str):
    def run(spark, sf):
        df = clean_events(spark, sf).select("row_id", "event_type", "value", F.col("user_id").cast("double"))
        step = FeatureCreation(["event_type", "value", "user_id"], "aggregations", aggregation_type=how,
                               new_column_name="g")
        out = step.fit(df).transform(df)
        return out.select("row_id", r6(F.col("g").cast("double")).alias("g"))
    return run


for _how in ("sum", "mean", "min", "max", "count"):
    query(f"group_agg_{_how}", _group_sql(_how))(_group_query(_how))


@query("corr_filter", """
WITH c AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS a, abs(corr(l_quantity, l_discount)) AS b,
  abs(corr(l_extendedprice, l_discount)) AS c, abs(corr(l_quantity, l_tax)) AS d,
  abs(corr(l_extendedprice, l_tax)) AS e, abs(corr(l_discount, l_tax)) AS f, abs(corr(l_quantity, q2)) AS g,
  abs(corr(l_extendedprice, q2)) AS h, abs(corr(l_discount, q2)) AS i, abs(corr(l_tax, q2)) AS j
  FROM (SELECT *, l_quantity * 2 + 1 AS q2 FROM lineitem))
SELECT 'l_extendedprice' AS "column", coalesce(a > 0.5, false) AS dropped FROM c
UNION ALL SELECT 'l_discount', coalesce(b > 0.5 OR c > 0.5, false) FROM c
UNION ALL SELECT 'l_tax', coalesce(d > 0.5 OR e > 0.5 OR f > 0.5, false) FROM c
UNION ALL SELECT 'q2', coalesce(g > 0.5 OR h > 0.5 OR i > 0.5 OR j > 0.5, false) FROM c""")
def q_corr_filter(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("q2", F.col("l_quantity") * 2 + 1)
    cols = selection_columns(df, ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "q2"])
    return correlation_decisions(df, cols, 0.5)


WIDE = [f"w{k}" for k in range(1, 27)]
WIDE_EXPRS = [f"CASE WHEN (l_partkey + l_linenumber) % {k + 2} > 0 THEN (l_orderkey * {k}) % 97 + {k % 3} * l_quantity END AS w{k}" for k in range(1, 27)]
WIDE_PAIRS = [(a, b) for i, a in enumerate(WIDE) for b in WIDE[i + 1:]]


@query("corr_wide", f"""
WITH w AS (SELECT {', '.join(WIDE_EXPRS)} FROM lineitem),
c AS (SELECT [{', '.join(f'abs(corr({a}, {b}))' for a, b in WIDE_PAIRS)}] AS r FROM w)
SELECT unnest({[a for a, _ in WIDE_PAIRS]}) AS col_a, unnest({[b for _, b in WIDE_PAIRS]}) AS col_b, round(unnest(r), 6) AS abs_corr FROM c""")
def q_corr_wide(spark, sf):
    """F14 over 325 pairs of columns with nulls, in one scan."""
    wide = table(spark, sf, "lineitem").selectExpr(*WIDE_EXPRS)
    return correlation_pairs(wide, WIDE, 0.9).select("col_a", "col_b", r6(F.col("abs_corr")).alias("abs_corr"))


@query("variance_threshold", """
SELECT 'l_quantity' AS "column", round(var_pop(l_quantity), 6) AS variance, var_pop(l_quantity) > 0.01 AS kept FROM lineitem
UNION ALL SELECT 'l_discount', round(var_pop(l_discount), 6), var_pop(l_discount) > 0.01 FROM lineitem
UNION ALL SELECT 'l_tax', round(var_pop(l_tax), 6), var_pop(l_tax) > 0.01 FROM lineitem""")
def q_variance_threshold(spark, sf):
    df = table(spark, sf, "lineitem")
    cols = selection_columns(df, ["l_quantity", "l_discount", "l_tax"])
    return variance_table(df, cols, 0.01).select("column", r6(F.col("variance")).alias("variance"), "kept")


# the threshold decides in SQL as well: a column that fails it would leave no row
@query("variance_select", """
WITH v AS (SELECT var_pop(l_quantity) > 0.01 AS q, var_pop(l_discount) > 0.01 AS d, var_pop(l_tax) > 0.01 AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem, v WHERE q AND NOT d AND NOT t""")
def q_variance_select(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    step = FeatureSelection(["l_quantity", "l_discount", "l_tax"], "variance_threshold", threshold=0.01)
    return step.fit(df).transform(df)


@query("pca")
def q_pca(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                                             "l_discount", "l_tax")
    step = FeatureSelection(["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "pca", n_components=2)
    out = step.fit(df).transform(df)
    return out.select("l_orderkey", "l_linenumber", r6(F.col("pca_component_1")).alias("pca_component_1"),
                      r6(F.col("pca_component_2")).alias("pca_component_2"))


@query("pca_two_columns", """
WITH m AS (SELECT avg(l_quantity) AS mx, avg(l_tax * 100) AS my, var_pop(l_quantity) AS a, var_pop(l_tax * 100) AS c,
                  covar_pop(l_quantity, l_tax * 100) AS b FROM lineitem),
e AS (SELECT *, (a + c) / 2 + sqrt(((a - c) / 2) * ((a - c) / 2) + b * b) AS l1 FROM m),
v AS (SELECT *, (l1 - c) / sqrt((l1 - c) * (l1 - c) + b * b) AS vx, b / sqrt((l1 - c) * (l1 - c) + b * b) AS vy FROM e)
SELECT l_orderkey, l_linenumber, round(abs((l_quantity - mx) * vx + (l_tax * 100 - my) * vy), 4) AS first,
  round(l1 / (a + c), 6) AS share FROM lineitem, v""")
def q_pca_two_columns(spark, sf):
    """The first of two components, up to its sign, and its share of the variance."""
    df = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_quantity", "l_tax * 100 AS tax")
    step = FeatureSelection(["l_quantity", "tax"], "pca", n_components=1).fit(df)
    share = step.params["explained_variance_ratio"][0]
    return step.transform(df).select("l_orderkey", "l_linenumber", F.round(F.abs("pca_component_1"), 4).alias("first"),
                                     F.round(F.lit(float(share)), 6).alias("share"))


@query("onehot_large", """
SELECT l_orderkey, l_linenumber,
  CAST(l_returnflag IS NOT DISTINCT FROM 'A' AS TINYINT) AS "l_returnflag_A",
  CAST(l_returnflag IS NOT DISTINCT FROM 'N' AS TINYINT) AS "l_returnflag_N",
  CAST(l_returnflag IS NOT DISTINCT FROM 'R' AS TINYINT) AS "l_returnflag_R",
  CAST(l_linestatus IS NOT DISTINCT FROM 'F' AS TINYINT) AS "l_linestatus_F",
  CAST(l_linestatus IS NOT DISTINCT FROM 'O' AS TINYINT) AS "l_linestatus_O" FROM lineitem""")
def q_onehot_large(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return Encoding(["l_returnflag", "l_linestatus"], "one-hot").fit(df).transform(df)


@query("label_encode_large", """
SELECT l_orderkey, l_linenumber, CAST(dense_rank() OVER (ORDER BY CAST(l_partkey AS VARCHAR)) - 1 AS BIGINT) AS part,
  CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS BIGINT) AS l_returnflag FROM lineitem""")
def q_label_encode_large(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("part"), "l_returnflag")
    return Encoding(["part", "l_returnflag"], "label").fit(df).transform(df)


@query("dedupe_large", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey * 10 + l_linenumber) AS rn FROM lineitem)
WHERE rn = 1""")
def q_dedupe_large(spark, sf):
    from ..operators import RemoveDuplicates
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                                             (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"))
    return RemoveDuplicates(["l_partkey", "l_suppkey"], "row_id").fit(df).transform(df).drop("row_id")


FEATURE_RUN_SPEC = [
    {"type": "encoding", "columns": ["c_mktsegment"], "method": "one-hot"},
    {"type": "scaling", "columns": ["c_acctbal"], "method": "standard"},
    {"type": "binning", "columns": ["c_acctbal"], "method": "quantile", "bins": 4},
]


@query("feature_run", """
WITH s AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS sd FROM customer),
sc AS (SELECT c_custkey, c_nationkey, c_mktsegment, (c_acctbal - m) / sd AS c_acctbal FROM customer, s),
q AS (SELECT list_sort(list_distinct(quantile_cont(c_acctbal, [0.0, 0.25, 0.5, 0.75, 1.0]))) AS es FROM sc),
b AS (SELECT c_custkey, c_nationkey, c_mktsegment, round(c_acctbal, 6) AS c_acctbal,
        CASE WHEN c_acctbal = es[1] THEN 0 ELSE CAST(len(list_filter(es, lambda v: v < c_acctbal)) - 1 AS INTEGER) END
        AS c_acctbal_binned FROM sc, q)
SELECT c_custkey, c_nationkey, c_acctbal, c_acctbal_binned,
  """ + SEGMENTS_SQL + " FROM b")
def q_feature_run(spark, sf):
    df = table(spark, sf, "customer").drop("c_name")
    res = run_features(df, FeatureSpec.from_dicts(FEATURE_RUN_SPEC))
    return res.output.withColumn("c_acctbal", r6(F.col("c_acctbal")))


LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("corr_filter_all_numeric", "WITH c AS (" + "\nUNION ALL ".join(
    f"SELECT '{b}' AS \"column\", " + " OR ".join(f"coalesce(abs(corr({a}, {b})) > 0.5, false)" for a in LINE_NUMBERS[:i]) + " AS dropped FROM lineitem"
    for i, b in enumerate(LINE_NUMBERS) if i) + """)
SELECT 'l_orderkey' AS "column" UNION ALL SELECT "column" FROM c WHERE NOT dropped UNION ALL SELECT 'l_returnflag'""")
def q_corr_filter_all_numeric(spark, sf):
    """no columns named, so all numeric ones are filtered; others stay."""
    df = table(spark, sf, "lineitem").select(*LINE_NUMBERS, "l_returnflag")
    left = FeatureSelection([], "correlation_filter", 0.5).fit(df).transform(df)
    return spark.createDataFrame([(c,) for c in left.columns], "column string")


@query("codes_that_grow", """
WITH a AS (SELECT DISTINCT o_orderstatus AS v FROM orders), b AS (SELECT DISTINCT o_orderpriority AS v FROM orders UNION SELECT 'F'),
c AS (SELECT v AS value, row_number() OVER (ORDER BY v) - 1 AS code, 1 AS version FROM a
      UNION ALL SELECT v, (SELECT count(*) FROM a) + row_number() OVER (ORDER BY v) - 1, 2 FROM b WHERE v NOT IN (SELECT v FROM a))
SELECT c.value, c.code, c.version::INTEGER AS version, count(o_orderkey) AS old_rows
FROM c LEFT JOIN orders ON o_orderstatus = c.value AND c.version = 1 GROUP BY ALL""")
def q_codes_that_grow(spark, sf):
    """a second column's values join the dictionary of the first; codes given before stay, and so does the old version."""
    orders = table(spark, sf, "orders")
    codes = CodeTable(spark, f"{ensure_checkpoint_dir(spark)}/codes-{uuid.uuid4().hex[:10]}")
    old = codes.extend(orders, "o_orderstatus")
    codes.extend(orders.select("o_orderpriority").union(spark.createDataFrame([("F",)], "v string")), "o_orderpriority")
    rows = codes.encode(orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", old).groupBy(F.col("o_orderstatus").alias("code")).agg(
        F.count("o_orderkey").alias("old_rows"))
    return codes.rows().join(rows, "code", "left").select("value", "code", "version", F.coalesce("old_rows", F.lit(0)).alias("old_rows"))
