"""Readers by extension, ingest to Parquet, Parquet hardening."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.missing import standardize_missing
from ..functions.types import qcol
from . import json_arrays
from .sinks import write_verified

ROW_ID = "_orig_idx"
FORMATS = {".parquet": "parquet", ".csv": "csv", ".tsv": "tsv", ".json": "json", ".jsonl": "jsonl",
           ".ndjson": "jsonl"}


def detect_format(path: str) -> str:
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext not in FORMATS:
        raise ValueError(f"Unsupported file type: {ext or path}")
    return FORMATS[ext]


def read_format(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "csv":
        return spark.read.csv(path, header=True, inferSchema=True, mode="PERMISSIVE")
    if fmt == "tsv":
        return spark.read.csv(path, header=True, inferSchema=True, sep="\t")
    if fmt == "json":
        return read_json(spark, path)  # arrays of records
    if fmt == "jsonl":
        return spark.read.json(path)
    raise ValueError(f"Unsupported file type: {fmt}")


def read_json(spark: SparkSession, path: str, range_bytes: int = json_arrays.RANGE_BYTES) -> DataFrame:
    """JSON arrays of records: files up to ``range_bytes`` are one task's work each, longer ones are read in ranges."""
    longest = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] or 0  # listed, not read
    if longest <= range_bytes:
        return spark.read.json(path, multiLine=True)
    return json_arrays.read_json_array(spark, path, range_bytes)


def load_table(spark: SparkSession, path: str, fmt: str | None = None, standardize: bool = True) -> DataFrame:
    """Read by extension (or explicit format), then the missing-marker rule."""
    df = read_format(spark, path, fmt or detect_format(path))
    return standardize_missing(df) if standardize else df


def with_row_id(df: DataFrame, name: str = ROW_ID) -> DataFrame:
    """Stable row position key. Parquet: (file, row index) from the hidden
    ``_metadata`` column as one sortable struct; other
    sources: ``monotonically_increasing_id`` (stable for a fixed file split)."""
    try:
        meta = df.select("_metadata.file_path", "_metadata.row_index")
        meta.schema  # noqa: B018 - forces analysis
        return df.withColumn(name, F.struct(F.col("_metadata.file_path").alias("file"),
                                            F.col("_metadata.row_index").alias("row")))
    except AnalysisException:  # no such column: not a file source
        return df.withColumn(name, F.monotonically_increasing_id())


def ingest_to_parquet(spark: SparkSession, src: str, target: str, fmt: str | None = None) -> int:
    """Any supported file -> Parquet; an unknown extension is tried as CSV.
    Returns the row count of the written table, which is checked against the source (S12)."""
    try:
        fmt = fmt or detect_format(src)
    except ValueError:
        fmt = "csv"
    return write_verified(storable(read_format(spark, src, fmt)), target)["rows"]


def storable(df: DataFrame) -> DataFrame:
    """collections/structs -> JSON text, decimals -> double, binary ->
    UTF-8 text (invalid bytes replaced), +-inf/NaN -> NULL; dates and timestamps stay."""
    return _plain(df, text_dates=False)


def json_safe(df: DataFrame) -> DataFrame:
    """As ``storable``, and dates/timestamps -> ISO text."""
    return _plain(df, text_dates=True)


def _plain(df: DataFrame, text_dates: bool) -> DataFrame:
    exprs = []
    for f in df.schema.fields:
        c, dt = qcol(f.name), f.dataType
        if isinstance(dt, (T.ArrayType, T.MapType, T.StructType)):
            e = F.to_json(c)
        elif isinstance(dt, T.DecimalType):
            e = c.cast("double")
        elif isinstance(dt, T.BinaryType):
            e = F.try_validate_utf8(c.cast("string"))
            e = F.coalesce(e, F.make_valid_utf8(c.cast("string")))
        elif isinstance(dt, (T.FloatType, T.DoubleType)):
            e = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        elif text_dates and isinstance(dt, T.DateType):
            e = F.date_format(c, "yyyy-MM-dd")
        elif text_dates and isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
            e = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        else:
            e = c
        exprs.append(e.alias(f.name))
    return df.select(*exprs)


def save_csv_text_as_parquet(spark: SparkSession, csv_path: str, target: str) -> int:
    """A CSV text file saved as a Parquet table."""
    return ingest_to_parquet(spark, csv_path, target, "csv")
