"""M5: leak-free categorical codes: dictionary from training rows only
(NULL -> ``'missing'``), unseen test values -> -1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rank import dense_codes
from ..operators.encode import INLINE_DICT, distinct_sets
from ..functions.types import qcol

MISSING_TEXT = "missing"


def fit_train_codes(train: DataFrame, columns) -> dict:
    """``{column: {"codes": {value: code}} | {"table": df, "size": n}}``."""
    keyed = train.select(*[F.coalesce(qcol(c).cast("string"), F.lit(MISSING_TEXT)).alias(c) for c in columns])
    small = distinct_sets(keyed, columns, INLINE_DICT)
    out = {}
    for c in columns:
        if small[c] is not None:
            out[c] = {"codes": {v: i for i, v in enumerate(small[c])}}
        else:
            t, size = dense_codes(keyed.select(qcol(c).alias("value")), "value", "code", with_count=True)
            out[c] = {"table": t, "size": size}
    return out


def apply_codes(df: DataFrame, dictionaries: dict) -> DataFrame:
    out = df
    for c, d in dictionaries.items():
        key = F.coalesce(qcol(c).cast("string"), F.lit(MISSING_TEXT))
        if "codes" in d:
            # up to INLINE_DICT values; a shuffle by them would put all rows of a value into one task
            t = F.broadcast(df.sparkSession.createDataFrame(list(d["codes"].items()), "_lk string, _code long"))
        else:
            t = d["table"].select(F.col("value").alias("_lk"), F.col("code").alias("_code"))
        cols = out.columns
        out = (out.withColumn("_lk", key).join(t, "_lk", "left")
               .select(*[F.coalesce(F.col("_code"), F.lit(-1)).cast("bigint").alias(x) if x == c else qcol(x)
                         for x in cols]))
    return out
