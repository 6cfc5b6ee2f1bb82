"""Profiling P1-P6 and the quality report Q1-Q6.

Every table here is a lazy DataFrame: one aggregate over all columns (partial
aggregation, fixed-size buffers) unpivoted with ``stack`` into one row per
column. Exact distinct counts are the default; ``approx=True`` switches to
HyperLogLog for very wide or very large tables. Only the quality *report*
(a dict) collects, and it collects these per-column rows, never data rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..functions.types import dtypes, is_datetime, is_numeric, is_numeric_or_bool, is_text, text_literal, type_name
from ..functions.missing import standardize_missing
from ..functions.types import qcol


def _stack(stats: DataFrame, rows: list[list[str]], names: list[str]) -> DataFrame:
    """Unpivot one aggregate row into ``len(rows)`` rows; each entry is a SQL expression."""
    body = ", ".join(", ".join(r) for r in rows)
    return stats.selectExpr(f"stack({len(rows)}, {body}) as ({', '.join(names)})")


_q = text_literal


def distinct_counts(df: DataFrame, approx: bool = False) -> DataFrame:
    """``(pos, distinct)`` of each column by position. Each column is grouped on its own: a scan
    that reads one column and combines before the shuffle. (Several distinct counts in one
    aggregate would send every row once per column.)"""
    if approx:
        one = df.agg(*[F.approx_count_distinct(qcol(c)).alias(f"d{i}") for i, c in enumerate(df.columns)])
        return _stack(one, [[str(i), f"d{i}"] for i in range(len(df.columns))], ["pos", "distinct"])
    out = None
    for i, c in enumerate(df.columns):
        one = df.select(qcol(c).alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.lit(1)).agg(F.count("*").alias("distinct"))
        one = one.select(F.lit(i).alias("pos"), "distinct")
        out = one if out is None else out.unionByName(one)
    return out


def _with_distinct(df: DataFrame, stats: DataFrame, name: str, approx: bool) -> DataFrame:
    """``stats`` (one row per column, with ``pos``) and the distinct counts, in column order."""
    counts = F.broadcast(distinct_counts(df, approx).withColumnRenamed("distinct", name))  # one row per column
    return stats.join(counts, "pos").orderBy("pos").drop("pos")


# ------------------------------------------------------------------ P1 / P2
def column_profile(df: DataFrame, row_key: str | None = None, approx: bool = False) -> DataFrame:
    """``(column, dtype, null_count, sample, distinct_count)`` over the full data.
    ``sample`` is the first non-null value in ``row_key`` order, as text."""
    aggs, rows = [], []
    for i, f in enumerate(df.schema.fields):
        c = qcol(f.name)
        sample = F.min_by(c, F.when(c.isNotNull(), qcol(row_key))) if row_key \
            else F.first(c, ignorenulls=True)
        aggs += [F.count(F.when(c.isNull(), 1)).alias(f"n{i}"), sample.cast("string").alias(f"s{i}")]
        rows.append([str(i), _q(f.name), _q(type_name(f.dataType)), f"n{i}", f"s{i}"])
    return _with_distinct(df, _stack(df.agg(*aggs), rows, ["pos", "column", "dtype", "null_count", "sample"]), "distinct_count", approx)


def preview_records(df: DataFrame, row_key: str, limit: int = 1000) -> DataFrame:
    """First ``limit`` rows in key order, JSON-safe (no NaN/inf, decimals
    as doubles, dates and timestamps as ISO text, nested values as JSON)."""
    from ..sources.readers import json_safe
    return json_safe(standardize_missing(df)).orderBy(qcol(row_key)).limit(limit)


def dataset_preview(df: DataFrame, row_key: str, limit: int = 1000, approx: bool = False) -> dict:
    """Column profile rows, the first ``limit`` records in key order and the total row count."""
    return {"columns": [r.asDict() for r in column_profile(df, row_key, approx).collect()],
            "records": [r.asDict() for r in preview_records(df, row_key, limit).collect()],
            "total_rows": df.count()}


# ------------------------------------------------------------------ Q1-Q6
def missing_table(df: DataFrame) -> DataFrame:
    """``(column, count, percentage, type)`` for columns with nulls."""
    n = F.count(F.lit(1))
    aggs, rows = [n.alias("_rows")], []
    for i, name in enumerate(df.columns):
        aggs.append(F.count(F.when(qcol(name).isNull(), 1)).alias(f"m{i}"))
        rows.append([_q(name), f"m{i}", f"_rows"])
    t = _stack(df.agg(*aggs), rows, ["column", "count", "rows"])
    pct = F.when(F.col("rows") > 0, F.col("count") * 100.0 / F.col("rows")).otherwise(F.lit(0.0))
    return (t.where(F.col("count") > 0)
            .select("column", "count", pct.alias("percentage"))
            .withColumn("type", F.when(F.col("percentage") > 50, "critical")
                        .when(F.col("percentage") > 10, "moderate").otherwise("minor")))


def duplicate_count(df: DataFrame, exclude: tuple = ()) -> DataFrame:
    """Q2: rows that repeat an earlier row (all columns except ``exclude``).

    Rows are counted by a fingerprint of 128 bits, so that wide rows don't travel; rows of one
    fingerprint are then compared in full. Those are all that repeat, and hardly any other."""
    cols = [qcol(c) for c in df.columns if c not in exclude]
    marked = df.select(*cols, fingerprint(cols).alias("_print")) if cols else df.select(F.lit(0).alias("_print"))
    repeated = marked.groupBy("_print").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_print")
    same = marked.join(repeated, "_print", "left_semi").groupBy("_print", *cols).agg(F.count(F.lit(1)).alias("_n"))
    return same.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def fingerprint(cols: list) -> Column:
    """128 bits of a row: equal rows have equal ones. Hashes pass over NULL, so where it stands is hashed, too
    (inside of arrays and structs it isn't)."""
    held = [*cols, *[c.isNull() for c in cols]]
    return F.concat(F.hex(F.xxhash64(*held)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), *held)))


def type_table(df: DataFrame, approx: bool = False) -> DataFrame:
    """Q3: ``(column, type, unique_values, is_categorical)``."""
    aggs, rows = [F.count(F.lit(1)).alias("_rows")], []
    for i, f in enumerate(df.schema.fields):
        rows.append([str(i), _q(f.name), _q(type_name(f.dataType)), "_rows", "true" if is_text(f.dataType) else "false"])
    t = _with_distinct(df, _stack(df.agg(*aggs), rows, ["pos", "column", "type", "rows", "is_text"]), "unique_values", approx)
    return t.select("column", "type", "unique_values",
                    (F.col("is_text") | (F.col("unique_values") < F.col("rows") * 0.1)).alias("is_categorical"))


def null_counts(df: DataFrame) -> tuple[int, dict[str, int]]:
    """Rows, and nulls per column, from one aggregate."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(qcol(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)]).collect()[0]
    return row["n"], {c: row[f"m{i}"] for i, c in enumerate(df.columns)}


def outlier_fences(df: DataFrame, exclude: tuple = (), factor: float = 1.5,
                   nulls: tuple[int, dict[str, int]] | None = None) -> dict:
    """Q4 fit: IQR fences of numeric columns that are less than half null.
    ``nulls``: what ``null_counts`` gave, if it is known."""
    cols = [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in exclude]
    if not cols:
        return {}
    n, missing = nulls or null_counts(df.select(*[qcol(c) for c in cols]))
    eligible = [c for c in cols if missing[c] < n * 0.5]
    out = {}
    for c, (q1, q3) in exact_quantiles(df, eligible, [0.25, 0.75]).items():
        if q1 is not None:
            out[c] = (q1 - factor * (q3 - q1), q3 + factor * (q3 - q1))
    return out


def outlier_table(df: DataFrame, fences: dict) -> DataFrame:
    """Q4/R2: ``(column, count, percentage, lower_bound, upper_bound)``; strict
    comparisons, denominator = all rows."""
    if not fences:
        return df.sparkSession.createDataFrame(
            [], "column string, count bigint, percentage double, lower_bound double, upper_bound double")
    aggs, rows = [F.count(F.lit(1)).alias("_rows")], []
    for i, (c, (lo, hi)) in enumerate(fences.items()):
        x = qcol(c)
        aggs.append(F.count(F.when((x < lo) | (x > hi), 1)).alias(f"o{i}"))
        rows.append([_q(c), f"o{i}", "_rows", f"CAST({lo!r} AS DOUBLE)", f"CAST({hi!r} AS DOUBLE)"])
    t = _stack(df.agg(*aggs), rows, ["column", "count", "rows", "lower_bound", "upper_bound"])
    return t.select("column", "count",
                    F.when(F.col("rows") > 0, F.col("count") * 100.0 / F.col("rows")).otherwise(0.0)
                    .alias("percentage"), "lower_bound", "upper_bound")


# The texts in the next function are fixed values: they are part of the results to match.
def quality_score_table(df: DataFrame, fences: dict, exclude: tuple = ()) -> DataFrame:
    """Q5/Q6: one row with the score, duplicate count and recommendation texts.
    Missing counts, outlier counts and the row count come from ONE aggregate
    over the table; the duplicate count is the only other pass."""
    cols = [c for c in df.columns if c not in exclude]
    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.count(F.when(qcol(c).isNull(), 1)).alias(f"m{i}") for i, c in enumerate(cols)]
    aggs += [F.count(F.when((qcol(c) < lo) | (qcol(c) > hi), 1)).alias(f"o{i}")
             for i, (c, (lo, hi)) in enumerate(fences.items())]
    n = F.col("_n")
    pct = lambda k: F.when(n > 0, F.col(k) * 100.0 / n).otherwise(0.0)
    m_sum = sum((pct(f"m{i}") for i in range(len(cols))), F.lit(0.0))
    m_cols = sum(((F.col(f"m{i}") > 0).cast("int") for i in range(len(cols))), F.lit(0))
    o_sum = sum((pct(f"o{i}") for i in range(len(fences))), F.lit(0.0))
    main = df.agg(*aggs).select(F.lit("s").alias("k"), m_sum.alias("m"), m_cols.alias("mc"), o_sum.alias("o"),
                                n.cast("double").alias("n"), F.lit(0.0).alias("d"))
    dups = duplicate_count(df, exclude).select(F.lit("d").alias("k"), *[F.lit(0.0).alias(x) for x in ("m", "mc", "o", "n")],
                                               F.col("duplicate_rows").cast("double").alias("d"))
    s = main.unionByName(dups).agg(*[F.sum(x).alias(x) for x in ("m", "mc", "o", "n", "d")])
    dup_pct = F.when(F.col("n") > 0, F.col("d") * 100.0 / F.col("n")).otherwise(0.0)
    score = F.greatest(F.lit(0.0), 100 - F.col("m") * 0.5 - dup_pct - F.col("o") * 0.3)
    recs = F.filter(F.array(
        F.when(F.col("mc") > 0, F.lit("Missing values detected - applying smart imputation")),
        F.when(F.col("d") > 0, F.concat(F.lit("Found "), F.col("d").cast("bigint").cast("string"),
                                        F.lit(" duplicate rows - removing duplicates"))),
        F.when(F.lit(len(fences) > 0), F.lit("Outliers detected - applying robust outlier handling"))),
        lambda x: x.isNotNull())
    return s.select(score.alias("quality_score"), F.col("d").cast("bigint").alias("duplicate_rows"),
                    recs.alias("recommendations"))


def quality_report(df: DataFrame, exclude: tuple = (), approx: bool = False) -> dict:
    """Q1-Q6 as a dict, from per-column rows (never data rows)."""
    df = standardize_missing(df)
    body = df.drop(*[c for c in exclude if c in df.columns])
    n, nulls = null_counts(body)
    share = {c: k * 100.0 / n for c, k in nulls.items() if k}
    missing = {c: {"count": nulls[c], "percentage": p, "type": "critical" if p > 50 else "moderate" if p > 10 else "minor"}
               for c, p in share.items()}
    dups = duplicate_count(body).collect()[0]["duplicate_rows"]
    types = {r["column"]: {"type": r["type"], "unique_values": r["unique_values"],
                           "is_categorical": r["is_categorical"]} for r in type_table(body, approx).collect()}
    fences = outlier_fences(body, nulls=(n, nulls))
    outliers = {r["column"]: {"count": r["count"], "percentage": r["percentage"],
                              "lower_bound": r["lower_bound"], "upper_bound": r["upper_bound"]}
                for r in outlier_table(body, fences).collect()}
    score = max(0.0, 100 - 0.5 * sum(v["percentage"] for v in missing.values())
                - ((dups / n * 100) if n else 0) - 0.3 * sum(v["percentage"] for v in outliers.values()))
    recs = []
    if missing:
        recs.append("Missing values detected - applying smart imputation")
    if dups > 0:
        recs.append(f"Found {dups} duplicate rows - removing duplicates")
    if outliers:
        recs.append("Outliers detected - applying robust outlier handling")
    return {"total_rows": n, "total_columns": len(body.columns), "missing_data": missing,
            "duplicate_rows": dups, "data_types": types, "outliers": outliers,
            "quality_score": score, "recommendations": recs}


# ------------------------------------------------------------------ P5
def column_insights(df: DataFrame, approx: bool = False) -> DataFrame:
    """P5: per column type flags, cardinality, missing count/%, and for numeric
    (booleans included) min/max/mean/sample std. ``approx=True`` uses
    HyperLogLog cardinalities."""
    aggs, rows = [F.count(F.lit(1)).alias("_rows")], []
    for i, f in enumerate(df.schema.fields):
        c, dt = qcol(f.name), f.dataType
        num = is_numeric_or_bool(dt)
        x = c.cast("double")
        aggs.append(F.count(F.when(c.isNull(), 1)).alias(f"m{i}"))
        if num:
            aggs += [F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.avg(x).alias(f"mu{i}"),
                     F.stddev_samp(x).alias(f"sd{i}")]
            stats = [f"lo{i}", f"hi{i}", f"mu{i}", f"sd{i}"]
        else:
            stats = ["CAST(NULL AS DOUBLE)"] * 4
        flags = ["true" if num else "false", "true" if is_text(dt) else "false",
                 "true" if is_datetime(dt) else "false", "true" if is_text(dt) else "false"]
        rows.append([str(i), _q(f.name), _q(type_name(dt)), f"m{i}", "_rows", *flags, *stats])
    t = _stack(df.agg(*aggs), rows, ["pos", "name", "dtype", "missing_count", "rows", "is_numeric",
                                     "is_categorical", "is_datetime", "is_text", "min_value", "max_value",
                                     "mean_value", "std_value"])
    t = _with_distinct(df, t, "cardinality", approx)
    pct = F.when(F.col("rows") > 0, F.col("missing_count") * 100.0 / F.col("rows")).otherwise(0.0)
    return t.select("name", "dtype", "cardinality", "missing_count", pct.alias("missing_percentage"),
                    "is_numeric", "is_categorical", "is_datetime", "is_text",
                    "min_value", "max_value", "mean_value", "std_value")


def first_values(df: DataFrame, column: str, row_key: str, k: int = 10) -> DataFrame:
    """P5: the first ``k`` distinct non-null values in order of appearance."""
    return (df.where(qcol(column).isNotNull()).groupBy(qcol(column).alias("_v"))
            .agg(F.min(qcol(row_key)).alias("_first"))
            .orderBy("_first").limit(k).select(F.col("_v").cast("string").alias("value"), "_first"))


# ------------------------------------------------------------------ P6
NUMERIC_STATS = ("min_value", "max_value", "mean_value", "std_value", "median_value")


def target_analysis(df: DataFrame, target: str) -> DataFrame:
    """One row of target statistics (numeric stats only for numeric, non-0/1 targets)."""
    types = dtypes(df)
    if target not in types:
        raise ValueError(f"Target column '{target}' not found in dataset")
    dt = types[target]
    t = qcol(target)
    num = is_numeric_or_bool(dt)
    x = t.cast("double")
    if type_name(dt) == "boolean":
        zero_one = F.lit(True)
    elif num:
        zero_one = F.count(F.when(~x.isin(0.0, 1.0), 1)) == 0
    else:
        zero_one = F.lit(False)
    stats = df.agg(F.count(t).alias("total_samples"), F.count_distinct(t).alias("unique_values"),
                   F.count(F.when(t.isNull(), 1)).alias("null_count"), F.count(F.lit(1)).alias("_rows"),
                   zero_one.alias("is_boolean"),
                   *([F.min(x).alias("min_value"), F.max(x).alias("max_value"), F.avg(x).alias("mean_value"),
                      F.stddev_samp(x).alias("std_value"),
                      F.lit(exact_quantiles(df, [target], [0.5])[target][0]).cast("double").alias("median_value")] if num else
                     [F.lit(None).cast("double").alias(n) for n in NUMERIC_STATS]))
    numeric_stats = F.lit(num) & ~F.col("is_boolean")
    return stats.select(
        F.lit(target).alias("column_name"), F.lit(type_name(dt)).alias("dtype"),
        F.lit(num).alias("is_numeric"), F.lit(is_text(dt)).alias("is_categorical"), "is_boolean",
        "total_samples", "unique_values",
        F.try_divide(F.col("unique_values").cast("double"), F.col("total_samples")).alias("unique_ratio"),
        "null_count", F.try_divide(F.col("null_count") * 100.0, F.col("_rows")).alias("null_percentage"),
        *[F.when(numeric_stats, qcol(n)).alias(n) for n in NUMERIC_STATS])


CLASS_TABLE_VALUES = 20  # fixed value: numeric targets with up to this many values have a class table


def target_classes(df: DataFrame, target: str, k: int = 10) -> DataFrame:
    """Class table of a text target or of a numeric one with few values: the ``k`` most
    frequent values and their counts; empty for any other target."""
    counts = df.where(qcol(target).isNotNull()).groupBy(qcol(target).alias("_v")).agg(F.count(F.lit(1)).alias("count"))
    few = counts.agg((F.count("*") <= CLASS_TABLE_VALUES).alias("_few"))  # one row
    shown = F.lit(is_text(dtypes(df)[target])) | (F.lit(is_numeric_or_bool(dtypes(df)[target])) & F.col("_few"))
    return (counts.join(F.broadcast(few)).where(shown).orderBy(F.desc("count"), F.asc("_v")).limit(k)
            .select(F.col("_v").cast("string").alias("value"), "count"))


def class_distribution(df: DataFrame, target: str, k: int = 10) -> DataFrame:
    """Top-``k`` values by count (ties by value), with share of non-null rows."""
    present = df.where(qcol(target).isNotNull())
    total = present.count()  # one scalar
    top = (present.groupBy(qcol(target).alias("_v")).agg(F.count(F.lit(1)).alias("count"))
           .orderBy(F.desc("count"), F.asc("_v")).limit(k))
    return top.select(F.col("_v").cast("string").alias("value"), "count",
                      (F.col("count") * 100.0 / F.lit(max(total, 1))).alias("percentage"))

