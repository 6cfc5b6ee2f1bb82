"""Diff queries (D1-D5): original vs cleaned table keyed by row id."""

from __future__ import annotations

from ..fixtures import clean_events, table
from ..operators.diff import DiffTables, deleted_rows, updated_cells
from ..plans.cleaning import CleanSpec, run_cleaning
from ..plans.features import FeatureSpec, run_features
from .cleaning import CLEAN_RUN_SPEC, CLEAN_RUN_SQL
from .features import FEATURE_RUN_SPEC
from . import query


def _cleaned(spark, sf):
    original = clean_events(spark, sf)
    res = run_cleaning(original, CleanSpec(**CLEAN_RUN_SPEC))
    return original, res.output


@query("diff_deleted_rows", CLEAN_RUN_SQL + """
SELECT c.row_id FROM clean_events c ANTI JOIN o ON c.row_id = o.row_id""")
def q_diff_deleted_rows(spark, sf):
    original, cleaned = _cleaned(spark, sf)
    return deleted_rows(original, cleaned, "row_id")


UPDATED_SQL = CLEAN_RUN_SQL + """,
j AS (SELECT c.row_id, c.event_id AS a1, o.event_id AS b1, c.user_id AS a2, o.user_id AS b2,
             c.event_type AS a3, o.event_type AS b3, c.value AS a4, o.value AS b4
      FROM clean_events c JOIN o ON c.row_id = o.row_id)
SELECT row_id, 'event_id' AS "column" FROM j WHERE a1 IS DISTINCT FROM b1
UNION ALL SELECT row_id, 'user_id' FROM j WHERE a2 IS DISTINCT FROM b2
UNION ALL SELECT row_id, 'event_type' FROM j WHERE a3 IS DISTINCT FROM b3
UNION ALL SELECT row_id, 'value' FROM j WHERE a4 IS DISTINCT FROM b4"""


@query("diff_updated_cells", UPDATED_SQL)
def q_diff_updated_cells(spark, sf):
    original, cleaned = _cleaned(spark, sf)
    return updated_cells(original, cleaned, "row_id")


@query("diff_bucketed_cells", UPDATED_SQL)
def q_diff_bucketed_cells(spark, sf):
    """D2 over tables bucketed by the row id: no shuffle under the joins."""
    return DiffTables(*_cleaned(spark, sf), "row_id").updated_cells()


@query("diff_bucketed_rows", CLEAN_RUN_SQL + """
SELECT c.row_id FROM clean_events c ANTI JOIN o ON c.row_id = o.row_id""")
def q_diff_bucketed_rows(spark, sf):
    return DiffTables(*_cleaned(spark, sf), "row_id").deleted_rows()


@query("diff_updated_cells_scaled", """
WITH s AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS sd FROM customer)
SELECT c_custkey AS row_id, 'c_acctbal' AS "column" FROM customer, s
WHERE c_acctbal IS DISTINCT FROM (c_acctbal - m) / sd""")
def q_diff_updated_cells_scaled(spark, sf):
    from ..operators import Scaling
    df = table(spark, sf, "customer")
    return updated_cells(df, Scaling(["c_acctbal"], "standard").fit(df).transform(df), "c_custkey")


@query("diff_filled_int", """
WITH h AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS k, o_orderstatus FROM orders),
m AS (SELECT quantile_cont(k, 0.5) AS med FROM h)
SELECT o_orderkey AS row_id, 'k' AS "column" FROM h, m WHERE k IS NULL AND med IS NOT NULL""")
def q_diff_filled_int(spark, sf):
    """Median fill turns an integer column into doubles; only the filled cells differ."""
    from ..operators import FillNulls
    o = table(spark, sf, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS k", "o_orderstatus")
    filled = FillNulls({"k": {"strategy": "median"}}).fit(o).transform(o)
    return updated_cells(o, filled, "o_orderkey")


@query("diff_nested", """
SELECT vec_id AS row_id, unnest(CASE WHEN vec_id % 3 = 0 THEN ['embedding', 'label'] ELSE ['embedding'] END) AS "column"
FROM embeddings WHERE vec_id % 3 = 0 OR vec_id % 7 = 0""")
def q_diff_nested(spark, sf):
    """D3: arrays are compared by value."""
    from pyspark.sql import functions as F
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    after = e.withColumn("embedding", F.when((F.col("vec_id") % 3 == 0) | (F.col("vec_id") % 7 == 0), F.slice("embedding", 2, 3)).otherwise(F.col("embedding")))
    return updated_cells(e, after.withColumn("label", F.when(F.col("vec_id") % 3 == 0, F.lit(-1)).otherwise(F.col("label"))), "vec_id")


@query("diff_column_sets", """
SELECT DISTINCT 'c_mktsegment_' || c_mktsegment AS "column", 'added' AS status FROM customer WHERE c_mktsegment IS NOT NULL
UNION ALL SELECT 'c_acctbal_binned', 'added'
UNION ALL SELECT 'c_mktsegment', 'removed'
UNION ALL SELECT unnest(['c_custkey', 'c_nationkey', 'c_acctbal']), 'kept'""")
def q_diff_column_sets(spark, sf):
    df = table(spark, sf, "customer").drop("c_name")
    res = run_features(df, FeatureSpec.from_dicts(FEATURE_RUN_SPEC))
    s = res.columns
    rows = ([(c, "added") for c in s["added_columns"]] + [(c, "removed") for c in s["removed_columns"]]
            + [(c, "kept") for c in s["original_columns"] if c not in s["removed_columns"]])
    return spark.createDataFrame(rows, "column string, status string")

