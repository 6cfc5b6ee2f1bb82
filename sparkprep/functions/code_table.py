"""Dictionaries of codes that grow (F7, M5): a value keeps its code for good.

A table holds one row per value: its code and the version that brought it. New values are
numbered in ascending order behind the last code and appended as the next version; nothing that was
written changes, so a model or an encoded table of an older version stays right, and any version can be
read again.

Codes learn from the rows given to ``extend`` only; with training rows alone, values that just test rows have stay
unknown (-1), as in ``ml.encode``. Defined cases: NULL is no value and gets no code; without new values
there is no new version; two writers at a time aren't provided for.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rank import dense_codes
from .types import qcol

SHAPE = "value string, code long, version int"
UNKNOWN = -1


class CodeTable:
    """The codes of one column, kept at a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self, version: int | None = None) -> DataFrame:
        """``(value, code, version)``, up to a version."""
        try:
            found = self.spark.read.schema(SHAPE).parquet(self.path)
        except AnalysisException:  # nothing written yet
            found = self.spark.createDataFrame([], SHAPE)
        return found if version is None else found.where(F.col("version") <= version)

    def version(self) -> int:
        return self.rows().agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def extend(self, df: DataFrame, column: str) -> int:
        """Codes for the values of a column that have none; the version that holds them all."""
        last = self.rows().agg(F.coalesce(F.max("version"), F.lit(0)).alias("version"), F.coalesce(F.max("code"), F.lit(-1)).alias("code")).first()
        values = df.select(qcol(column).cast("string").alias("value")).where("value IS NOT NULL").distinct()
        new, n = dense_codes(values.join(self.rows().select("value"), "value", "left_anti"), "value", "code", with_count=True)
        if not n:
            return last["version"]
        new.select("value", (F.col("code") + last["code"] + 1).alias("code"), F.lit(last["version"] + 1).alias("version")) \
            .write.mode("append").parquet(self.path)
        return last["version"] + 1

    def encode(self, df: DataFrame, column: str, version: int | None = None) -> DataFrame:
        """The column as codes; values unknown to the version, and NULL, are -1."""
        codes = self.rows(version).select(F.col("value").alias("_value"), F.col("code").alias("_code"))
        joined = df.join(codes, qcol(column).cast("string") == F.col("_value"), "left")
        return joined.select(*[F.coalesce("_code", F.lit(UNKNOWN)).cast("long").alias(c) if c == column else qcol(c) for c in df.columns])
