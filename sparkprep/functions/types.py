"""Column type predicates (the reference's dtype tests, widened to every Spark numeric type)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def is_numeric(dt: T.DataType) -> bool:
    """``select_dtypes(np.number)``: every numeric type, booleans excluded."""
    return isinstance(dt, T.NumericType)


def is_numeric_or_bool(dt: T.DataType) -> bool:
    """``is_numeric_dtype``: numeric types and booleans."""
    return isinstance(dt, (T.NumericType, T.BooleanType))


def is_integral(dt: T.DataType) -> bool:
    return isinstance(dt, T.IntegralType)


def is_floating(dt: T.DataType) -> bool:
    return isinstance(dt, (T.FloatType, T.DoubleType))


def is_text(dt: T.DataType) -> bool:
    return isinstance(dt, T.StringType)


def is_datetime(dt: T.DataType) -> bool:
    return isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_collection(dt: T.DataType) -> bool:
    return isinstance(dt, (T.ArrayType, T.MapType))


def dtypes(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in exclude]


def text_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if is_text(f.dataType) and f.name not in exclude]


def type_name(dt: T.DataType) -> str:
    return dt.simpleString()


def qcol(name: str):
    """Reference a column by its literal name (dots, spaces and backticks in
    user column names or one-hot values are not parsed as nested fields)."""
    from pyspark.sql import functions as F
    return F.col("`" + name.replace("`", "``") + "`")


def text_literal(value: str) -> str:
    """``value`` as a SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def present(name: str, dt):
    """The column with NaN as NULL: what a fit sees (pandas skips both)."""
    from pyspark.sql import functions as F
    c = qcol(name)
    return F.when(~F.isnan(c), c) if is_floating(dt) else c


def missing(name: str, dt):
    """NULL, or NaN for floating columns (pandas' single notion of missing)."""
    from pyspark.sql import functions as F
    c = qcol(name)
    return (c.isNull() | F.isnan(c)) if is_floating(dt) else c.isNull()
