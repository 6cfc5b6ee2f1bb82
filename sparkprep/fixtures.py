"""Derived views over the driver tables, defined identically in Spark and SQL.

``dirty_events``: ``events`` with ``value`` NULL when ``event_id % 7 = 0``,
``event_type`` set to ``' N/A '`` when ``event_id % 13 = 0`` and to ``''`` when
``event_id % 17 = 0``, plus a second copy of every row with
``event_id % 10 = 0`` (full-row duplicates). ``row_id`` is the row position
key: ``2*event_id`` for the originals and ``2*event_id + 1`` for the copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.missing import standardize_missing


_TABLES: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table; the DataFrame (listing + footer schema) is reused per session."""
    key = (id(spark._jsparkSession), f"{sf_dir}/{name}.parquet")
    if key not in _TABLES:
        _TABLES[key] = spark.read.parquet(key[1])
    return _TABLES[key]


def dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    d = ev.select(
        "event_id", "ts", "user_id",
        F.when(eid % 13 == 0, F.lit(" N/A ")).when(eid % 17 == 0, F.lit("")).otherwise(F.col("event_type"))
        .alias("event_type"),
        F.when(eid % 7 == 0, F.lit(None).cast("double")).otherwise(F.col("value")).alias("value"),
        "props")
    originals = d.withColumn("row_id", eid * 2)
    copies = d.where(eid % 10 == 0).withColumn("row_id", eid * 2 + 1)
    return originals.unionByName(copies)


def clean_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``dirty_events`` after the missing-marker rule."""
    return standardize_missing(dirty_events(spark, sf_dir))


# ---------------------------------------------------------------- SQL twins
#: The rule, written out on its own for the oracle.
SQL_STRIP = "(" + " || ".join(f"chr({n})" for n in (
    9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)) + ")"


def sql_missing_text(col: str) -> str:
    s = f"trim({col}, {SQL_STRIP})"
    return (f"({s} = '' OR lower({s}) IN ('na', 'n/a', 'none', 'null', 'nan') "
            f"OR {s} IN ('[]', '{{}}', '[ ]', '{{ }}', '()', '( )', '\"\"', ))")


def sql_clean_text(col: str) -> str:
    return f"CASE WHEN {sql_missing_text(col)} THEN NULL ELSE {col} END"


def sql_clean_double(col: str) -> str:
    return f"CASE WHEN isnan({col}) OR isinf({col}) THEN NULL ELSE {col} END"


DIRTY_EVENTS_SQL = """dirty_events AS (
  SELECT event_id, ts, user_id,
         CASE WHEN event_id % 13 = 0 THEN ' N/A ' WHEN event_id % 17 = 0 THEN '' ELSE event_type END AS event_type,
         CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value, props, event_id * 2 AS row_id
  FROM events
  UNION ALL
  SELECT event_id, ts, user_id,
         CASE WHEN event_id % 13 = 0 THEN ' N/A ' WHEN event_id % 17 = 0 THEN '' ELSE event_type END AS event_type,
         CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value, props, event_id * 2 + 1 AS row_id
  FROM events WHERE event_id % 10 = 0)"""


def clean_events_sql() -> str:
    return (DIRTY_EVENTS_SQL + ",\nclean_events AS (SELECT event_id, ts, user_id, "
            f"{sql_clean_text('event_type')} AS event_type, {sql_clean_double('value')} AS value, "
            f"{sql_clean_text('props')} AS props, row_id FROM dirty_events)")
