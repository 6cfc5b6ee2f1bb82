"""Query a SQL database through JDBC: preview (first 20 rows) and ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PREVIEW_ROWS = 20


def jdbc_reader(spark: SparkSession, url: str, query: str, user: str | None = None,
                password: str | None = None, driver: str | None = None, partition: dict | None = None):
    r = spark.read.format("jdbc").option("url", url)
    if partition:  # parallel ranged reads: {"column", "lower", "upper", "num"}
        r = (r.option("dbtable", f"({query}) q").option("partitionColumn", partition["column"])
             .option("lowerBound", partition["lower"]).option("upperBound", partition["upper"])
             .option("numPartitions", partition["num"]))
    else:
        r = r.option("query", query)
    for k, v in (("user", user), ("password", password), ("driver", driver)):
        if v is not None:
            r = r.option(k, v)
    return r


def sql_preview(spark: SparkSession, url: str, query: str, **kw) -> DataFrame:
    return jdbc_reader(spark, url, query, **kw).load().limit(PREVIEW_ROWS)


def ingest_sql(spark: SparkSession, url: str, query: str, target_dir: str, name: str, **kw) -> dict:
    from .sinks import write_verified
    fname = name if name.endswith(".parquet") else f"{name}.parquet"
    return write_verified(jdbc_reader(spark, url, query, **kw).load(), f"{target_dir.rstrip('/')}/{fname}")
