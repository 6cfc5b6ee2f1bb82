"""Differences between a table before and after cleaning, keyed by row id.

Deleted rows are a ``left_anti`` join; updated cells are an inner join on the
row id with one null-safe inequality per shared column, unpivoted to
``(row_id, column)``. No row cap: the result stays distributed; callers limit
only what they display.

``DiffTables`` keeps both sides as tables bucketed by the row id, so that every
question about them joins without a shuffle, and compares rows by a fingerprint
before it reads their cells.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import is_numeric_or_bool, qcol
from ..session import ensure_checkpoint_dir
from .profile import fingerprint


def deleted_rows(original: DataFrame, cleaned: DataFrame, key: str) -> DataFrame:
    """Keys present before and absent after, in order."""
    a = original.select(qcol(key).alias("_k"))
    return a.join(cleaned.select(qcol(key).alias("_k")), "_k", "left_anti").orderBy("_k").select(F.col("_k").alias(key))


def comparable(c, dt):
    """D3: maps compare by sorted entries; arrays/structs compare natively; NaN is NULL."""
    if isinstance(dt, T.MapType):
        return F.to_json(F.array_sort(F.map_entries(c)))
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c)
    return c


def _shared(original: DataFrame, cleaned: DataFrame, key: str) -> list[str]:
    return [c for c in original.columns if c in cleaned.columns and c != key]


def _alike(c: Column, mine: T.DataType, other: T.DataType) -> Column:
    """The cell in the form in which both sides compare."""
    c = comparable(c, mine)
    if mine == other:
        return c
    return c.cast("double") if is_numeric_or_bool(mine) and is_numeric_or_bool(other) else c.cast("string")  # 5 equals 5.0


def updated_cells(original: DataFrame, cleaned: DataFrame, key: str) -> DataFrame:
    """``(row_id, column)`` for every cell that differs (NULL equals NULL)."""
    o_types = {f.name: f.dataType for f in original.schema.fields}
    c_types = {f.name: f.dataType for f in cleaned.schema.fields}
    shared = _shared(original, cleaned, key)
    if not shared:
        return original.sparkSession.createDataFrame([], f"row_id {original.schema[key].dataType.simpleString()}, column string")
    a = original.select(qcol(key).alias("_k"), *[qcol(c).alias(f"a{i}") for i, c in enumerate(shared)])
    b = cleaned.select(qcol(key).alias("_k"), *[qcol(c).alias(f"b{i}") for i, c in enumerate(shared)])
    j = a.join(b, on="_k", how="inner")
    flags = []
    for i, c in enumerate(shared):
        x, y = _alike(F.col(f"a{i}"), o_types[c], c_types[c]), _alike(F.col(f"b{i}"), c_types[c], o_types[c])
        flags.append(F.when(~x.eqNullSafe(y), F.lit(c)))
    changed = j.select(F.col("_k").alias("row_id"), F.explode(F.filter(F.array(*flags), lambda v: v.isNotNull()))
                       .alias("column"))
    return changed


class DiffTables:
    """Both sides of a diff as tables in the shared checkpoint folder, bucketed and sorted by the row id: one shuffle
    each when they are written, none for the questions. Each row has a fingerprint of its cells, in the form
    in which they compare; cells are read only of rows whose fingerprints differ. Ids are unique."""

    def __init__(self, original: DataFrame, cleaned: DataFrame, key: str, buckets: int | None = None):
        self.spark, self.key = original.sparkSession, key
        self.shared = _shared(original, cleaned, key)
        self.buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.before, self.after = self._write(original, cleaned), self._write(cleaned, original)

    def _write(self, mine: DataFrame, other: DataFrame) -> DataFrame:
        types, others = ({f.name: f.dataType for f in d.schema.fields} for d in (mine, other))
        cells = [_alike(qcol(c), types[c], others[c]).alias(f"v{i}") for i, c in enumerate(self.shared)]
        rows = mine.select(qcol(self.key).alias("_k"), *cells)
        nested = [f.name for f in rows.schema.fields if isinstance(f.dataType, (T.ArrayType, T.StructType))]
        values = [F.to_json(F.col(c), {"ignoreNullFields": "false"}) if c in nested else F.col(c) for c in rows.columns[1:]]
        name = f"diff_{uuid.uuid4().hex}"
        (rows.select("*", (fingerprint(values) if values else F.lit("")).alias("_print")).repartition(self.buckets, "_k")
         .write.bucketBy(self.buckets, "_k").sortBy("_k").option("path", f"{ensure_checkpoint_dir(self.spark)}/{name}").saveAsTable(name))
        return self.spark.table(name)

    def deleted_rows(self) -> DataFrame:
        """D1, without an order."""
        return self.before.select("_k").join(self.after.select("_k"), "_k", "left_anti").select(F.col("_k").alias(self.key))

    def changed_rows(self) -> DataFrame:
        """Ids of rows with a changed cell: only ids and fingerprints are read."""
        a, b = (t.select("_k", "_print") for t in (self.before, self.after))
        return a.join(b.withColumnRenamed("_print", "_other"), "_k").where("_print <> _other").select("_k")

    def updated_cells(self) -> DataFrame:
        """D2."""
        changed = self.changed_rows()
        a = self.before.join(changed, "_k", "left_semi").drop("_print")
        b = self.after.select("_k", *[F.col(f"v{i}").alias(f"w{i}") for i in range(len(self.shared))])
        flags = [F.when(~F.col(f"v{i}").eqNullSafe(F.col(f"w{i}")), F.lit(c)) for i, c in enumerate(self.shared)]
        cells = F.filter(F.array(*flags) if flags else F.array().cast("array<string>"), lambda v: v.isNotNull())
        return a.join(b, "_k").select(F.col("_k").alias("row_id"), F.explode(cells).alias("column"))


def column_summary(before: list[str], after: list[str]) -> dict:
    """Added / removed column names."""
    return {"original_columns": list(before), "engineered_columns": list(after),
            "added_columns": [c for c in after if c not in before],
            "removed_columns": [c for c in before if c not in after]}


def column_summary_frame(spark, before: DataFrame, after: DataFrame) -> DataFrame:
    s = column_summary(before.columns, after.columns)
    return spark.createDataFrame([(s["added_columns"], s["removed_columns"], len(before.columns),
                                   len(after.columns))],
                                 "added_columns array<string>, removed_columns array<string>, "
                                 "original_count int, engineered_count int")
