"""Mergeable quantile sketches, kept per part of a table (a day, a file).

A part's sketches are made once, when it arrives, and written beside it: per column the
count, the extremes and a KLL sketch. Sketches of all parts merge to those of the table without
reading any part again; they answer approximate quantiles at once, and give
``exact_quantiles`` its brackets, so that an exact result takes one scan.

Defined cases: NULL and NaN are ignored; a column without values has a count of 0 and no
sketch; a part without rows has no sketches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .types import qcol

#: Size of a sketch, and a rank error (as a share of the count) that it keeps with some 99.9 %.
SIZE, SKETCH_ERROR = 2048, 0.006


def build(df: DataFrame, columns, by: Column | None = None, size: int = SIZE) -> DataFrame:
    """``(part, column, n, lo, hi, sketch)``: one aggregate over all columns, combined before the shuffle."""
    value = lambda c: F.when(~F.isnan(qcol(c).cast("double")), qcol(c).cast("double"))
    rows = df.select((F.lit(None) if by is None else by).cast("string").alias("part"), *[value(c).alias(f"x{i}") for i, c in enumerate(columns)])
    one = lambda x: F.struct(F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"),
                             F.kll_sketch_agg_double(x, size).alias("sketch"))
    each = rows.groupBy("part").agg(*[one(f"x{i}").alias(f"s{i}") for i in range(len(columns))])
    named = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("s")) for i, c in enumerate(columns)])
    return each.select("part", F.explode(named).alias("e")).select("part", "e.column", "e.s.*")


def merge(sketches: DataFrame) -> DataFrame:
    """The sketches of all parts together, per column."""
    some = F.when(F.col("n") > 0, F.col("sketch"))
    return sketches.groupBy("column").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.kll_merge_agg_double(some).alias("sketch"))


def estimates(sketches: DataFrame, probs: list[float]) -> dict[str, tuple]:
    """column -> (n, lowest, highest value, approximate quantiles); one short row per column."""
    near = F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(p) for p in probs])))
    found = merge(sketches).select("column", "n", "lo", "hi", near.alias("near")).collect()
    return {r["column"]: (r["n"], r["lo"], r["hi"], r["near"]) for r in found}
