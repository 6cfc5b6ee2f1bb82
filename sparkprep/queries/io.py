"""Source/sink queries (S1-S16): round trips through every supported format,
written to a run-specific folder under the shared checkpoint directory."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..fixtures import table
from ..operators import FeatureCreation
from ..session import ensure_checkpoint_dir
from ..sources.readers import ingest_to_parquet, load_table, read_json, save_csv_text_as_parquet
from ..sources.sinks import export_csv, write_json_arrays, write_stage, write_verified
from . import query

CUSTOMER_SQL = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"
# text sources: Spark's schema inference gives INT for values that fit, JSON gives BIGINT for integers
CUSTOMER_CSV_SQL = ("SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment "
                    "FROM customer")
CUSTOMER_JSON_SQL = ("SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment "
                     "FROM customer")


def _scratch(spark, what: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{what}-{uuid.uuid4().hex[:10]}"


@query("parquet_read", CUSTOMER_SQL)
def q_parquet_read(spark, sf):
    return load_table(spark, f"{sf}/customer.parquet")


@query("csv_roundtrip", CUSTOMER_CSV_SQL)
def q_csv_roundtrip(spark, sf):
    path = _scratch(spark, "export") + "/customer.csv"
    export_csv(table(spark, sf, "customer").withColumn("_orig_idx", F.col("c_custkey")), path)
    return load_table(spark, path)


@query("tsv_ingest", CUSTOMER_CSV_SQL)
def q_tsv_ingest(spark, sf):
    path = _scratch(spark, "tsv") + "/customer.tsv"
    table(spark, sf, "customer").write.option("header", True).option("sep", "\t").csv(path)
    target = _scratch(spark, "ingest") + "/customer.parquet"
    ingest_to_parquet(spark, path, target)
    return spark.read.parquet(target)


@query("json_array_ingest", CUSTOMER_JSON_SQL)
def q_json_array_ingest(spark, sf):
    path = _scratch(spark, "jsonarr") + "/customer.json"
    write_json_arrays(table(spark, sf, "customer"), path)
    return load_table(spark, path).select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query("json_array_split", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def q_json_array_split(spark, sf):
    """Long arrays are read in ranges of bytes, whose borders fall anywhere in a record."""
    path = _scratch(spark, "jsonsplit") + "/documents.json"
    write_json_arrays(table(spark, sf, "documents"), path)
    return read_json(spark, path, range_bytes=1 << 18).select("doc_id", "text", "lang", "source", "n_chars")


@query("jsonl_ingest", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def q_jsonl_ingest(spark, sf):
    path = _scratch(spark, "jsonl") + "/events.jsonl"
    table(spark, sf, "events").write.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)
    target = _scratch(spark, "ingest") + "/events.parquet"
    ingest_to_parquet(spark, path, target)  # JSON has no timestamps: the text is the value
    return spark.read.parquet(target).select(
        "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props")


@query("parquet_ingest_types", "SELECT event_id, ts, value FROM events")
def q_parquet_ingest_types(spark, sf):
    """Timestamps stay timestamps."""
    target = _scratch(spark, "ingest") + "/events.parquet"
    ingest_to_parquet(spark, f"{sf}/events.parquet", target)
    return spark.read.parquet(target).select("event_id", "ts", "value")


@query("embeddings_to_parquet", """
SELECT vec_id, len(embedding)::INTEGER AS n, round(embedding[1]::DOUBLE, 4) AS first, label FROM embeddings""")
def q_embeddings_to_parquet(spark, sf):
    """An array column becomes JSON text and can be read back."""
    from ..sources.readers import storable
    path = _scratch(spark, "embeddings") + "/embeddings.parquet"
    write_verified(storable(table(spark, sf, "embeddings")), path)
    back = F.from_json("embedding", "array<float>")
    return spark.read.parquet(path).select("vec_id", F.size(back).alias("n"), F.round(F.get(back, F.lit(0)).cast("double"), 4).alias("first"), "label")


@query("unknown_extension_as_csv", CUSTOMER_CSV_SQL)
def q_unknown_extension_as_csv(spark, sf):
    path = _scratch(spark, "raw") + "/customer.dat"
    table(spark, sf, "customer").write.option("header", True).csv(path)
    target = _scratch(spark, "ingest") + "/customer.parquet"
    ingest_to_parquet(spark, path, target)
    return spark.read.parquet(target)


@query("stage_write_verified", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def q_stage_write_verified(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    info = write_stage(df, _scratch(spark, "stages"), f"{sf}/orders.parquet", "cleaned")
    return spark.read.parquet(info["path"])


@query("stage_write_engineered", """
SELECT c_custkey, c_acctbal, round(c_acctbal * c_acctbal, 4) AS squared, 'feature_engineered_customer.parquet' AS stage FROM customer""")
def q_stage_write_engineered(spark, sf):
    """The feature stage, under its name."""
    df = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    step = FeatureCreation(["c_acctbal"], "polynomial", 2).fit(df)
    info = write_stage(step.transform(df), _scratch(spark, "stages"), f"{sf}/customer.parquet", "engineered")
    return spark.read.parquet(info["path"]).select("c_custkey", "c_acctbal", F.round("c_acctbal^2", 4).alias("squared"),
                                                   F.lit(info["path"].rsplit("/", 1)[1]).alias("stage"))


@query("csv_text_to_parquet", CUSTOMER_CSV_SQL)
def q_csv_text_to_parquet(spark, sf):
    """A CSV text saved as a Parquet table."""
    path = _scratch(spark, "text") + "/customer.csv"
    export_csv(table(spark, sf, "customer"), path)
    target = _scratch(spark, "saved") + "/customer.parquet"
    save_csv_text_as_parquet(spark, path, target)
    return spark.read.parquet(target)


@query("nested_to_parquet", """
SELECT o_orderkey, '{"k":' || CAST(o_orderkey AS VARCHAR) || ',"s":"' || o_orderstatus || '"}' AS nested,
       round(o_totalprice, 2) AS price FROM orders""")
def q_nested_to_parquet(spark, sf):
    from ..sources.readers import json_safe
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s")).alias("nested"),
        F.round("o_totalprice", 2).cast("decimal(14,2)").alias("price"))
    path = _scratch(spark, "nested") + "/orders.parquet"
    write_verified(json_safe(o), path)
    return spark.read.parquet(path)
