"""The result-table logic of the reference's screens as DataFrame
operations (filter, sort, page, bucket counts, summaries, leaderboards)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rank_select import Key, rows_at
from ..functions.types import dtypes, present, qcol

# fixed values of the rules
HIGH, MEDIUM = 80.0, 60.0
HISTOGRAM = [("90-100%", 90.0, None), ("80-90%", 80.0, 90.0), ("70-80%", 70.0, 80.0), ("60-70%", 60.0, 70.0),
             ("Below 60%", None, 60.0)]
FAMILIES = [(("logistic", "linear"), "Linear Models"), (("forest",), "Ensemble Methods"),
            (("xgboost", "lightgbm"), "Gradient Boosting"), (("svm",), "Support Vector"),
            (("knn",), "Nearest Neighbors")]


def contains_filter(df: DataFrame, filters: dict) -> DataFrame:
    """V1: per-column case-insensitive substring filter, AND over columns."""
    cond = F.lit(True)
    for c, v in filters.items():
        if v in (None, ""):
            continue
        cond = cond & F.lower(F.coalesce(qcol(c).cast("string"), F.lit(""))).contains(str(v).lower())
    return df.where(cond)


def sort_by(df: DataFrame, column: str, ascending: bool = True, tiebreak: list[str] | None = None) -> DataFrame:
    """V2: one sort column (NULLs first ascending, last descending) plus a stable tie-break."""
    key = qcol(column).asc_nulls_first() if ascending else qcol(column).desc_nulls_last()
    return df.orderBy(key, *[qcol(t).asc() for t in (tiebreak or [])])


def page(df: DataFrame, order: list[Key | str], page_no: int, size: int) -> DataFrame:
    """V3/V5: 0-based page of ``size`` rows in a total order. The ranges of keys that hold the page are found
    by counting, and only their rows are sorted."""
    return rows_at(df, order, page_no * size, size)


def search_predictions(df: DataFrame, term: str, prediction: str, index: str) -> DataFrame:
    """V4: value contains the term, or the 1-based row number contains it."""
    t = str(term).lower()
    return df.where(F.lower(qcol(prediction).cast("string")).contains(t)
                    | (qcol(index) + 1).cast("string").contains(t))


def confidence_band(conf: Column) -> Column:
    """V4: high >= 80, medium 60-80, low < 60 (percent)."""
    pct = conf * 100
    return F.when(pct >= HIGH, "high").when(pct >= MEDIUM, "medium").when(pct.isNotNull(), "low")


def confidence_histogram(df: DataFrame, conf: str) -> DataFrame:
    """V6: counts per band, zero-filled, in display order (one aggregate)."""
    pct = qcol(conf) * 100
    aggs = []
    for i, (_, lo, hi) in enumerate(HISTOGRAM):
        cond = pct.isNotNull()
        for j, (_, lo2, _) in enumerate(HISTOGRAM[:i]):
            cond = cond & (pct < lo2)
        if lo is not None:
            cond = cond & (pct >= lo)
        aggs.append(F.count(F.when(cond, 1)).alias(f"b{i}"))
    body = ", ".join(f"{i}, '{name}', b{i}" for i, (name, _, _) in enumerate(HISTOGRAM))
    return df.agg(*aggs).selectExpr(f"stack({len(HISTOGRAM)}, {body}) as (position, range, count)")


def prediction_summary(df: DataFrame, prediction: str, conf: str | None, problem_type: str) -> DataFrame:
    """V8: classification -> avg/max/min confidence (percent), distinct classes, total;
    regression -> avg/max/min value, total. Empty inputs give 0."""
    if problem_type == "classification":
        c = qcol(conf)
        return df.agg((F.coalesce(F.avg(c), F.lit(0.0)) * 100).alias("avg_confidence"),
                      (F.coalesce(F.max(c), F.lit(0.0)) * 100).alias("max_confidence"),
                      (F.coalesce(F.min(c), F.lit(0.0)) * 100).alias("min_confidence"),
                      F.count_distinct(qcol(prediction)).alias("unique_classes"),
                      F.count(F.lit(1)).alias("total_predictions"))
    v = qcol(prediction).try_cast("double")
    return df.agg(F.coalesce(F.avg(v), F.lit(0.0)).alias("avg_value"), F.coalesce(F.max(v), F.lit(0.0)).alias("max_value"),
                  F.coalesce(F.min(v), F.lit(0.0)).alias("min_value"), F.count(F.lit(1)).alias("total_predictions"))


def export_predictions(pred: DataFrame, conf: str = "confidence") -> DataFrame:
    """V9: input columns + prediction, confidence rounded to 4 decimals."""
    return pred.withColumn(conf, F.round(qcol(conf), 4)) if conf in pred.columns else pred


def schema_check(df: DataFrame, expected: list[str]) -> dict:
    """Missing and extra columns against the expected list."""
    return {"missing": [c for c in expected if c not in df.columns],
            "extra": [c for c in df.columns if c not in expected]}


def schema_report(df: DataFrame, expected: list[str]) -> DataFrame:
    """V10 with the data: ``(column, status, present)`` of every expected or given column; ``present`` counts its
    non-null values (one aggregate), null where the column is missing."""
    types = dtypes(df)
    here = [c for c in df.columns]
    counted = df.agg(*[F.count(present(c, types[c])).alias(f"n{i}") for i, c in enumerate(here)])
    rows = [F.struct(F.lit(c).alias("column"), F.lit("expected" if c in expected else "extra").alias("status"), F.col(f"n{i}").alias("present"))
            for i, c in enumerate(here)]
    rows += [F.struct(F.lit(c).alias("column"), F.lit("missing").alias("status"), F.lit(None).cast("long").alias("present"))
             for c in expected if c not in here]
    return counted.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def model_family(name: Column) -> Column:
    out = None
    for words, fam in FAMILIES:
        cond = F.lit(False)
        for w in words:
            cond = cond | name.contains(w)
        out = F.when(cond, fam) if out is None else out.when(cond, fam)
    return out.otherwise("Other")


def leaderboard(models: DataFrame, problem_type: str | None = None, family: str | None = None,
                sort: str = "date") -> DataFrame:
    """V11 over the registry table (model_id, problem_type, best_model, score, created_at, ...)."""
    t = models.withColumn("family", model_family(F.coalesce(F.col("best_model"), F.lit("Unknown"))))
    if problem_type and problem_type != "all":
        t = t.where(F.col("problem_type") == problem_type)
    if family and family != "all":
        t = t.where(F.col("family") == family)
    key = {"date": F.col("created_at").desc_nulls_last(), "accuracy": F.coalesce(F.col("score"), F.lit(0.0)).desc(),
           "name": F.col("best_model").asc()}[sort]
    return t.orderBy(key, F.col("model_id"))


def group_models(models: DataFrame) -> DataFrame:
    """File -> target -> models, and counts per problem type."""
    return (models.groupBy(F.coalesce(F.col("filename"), F.lit("Unknown")).alias("file"),
                           F.coalesce(F.col("target_column"), F.lit("Unknown")).alias("target"))
            .agg(F.sort_array(F.collect_list("model_id")).alias("models"), F.count(F.lit(1)).alias("n")))


def type_counts(models: DataFrame) -> DataFrame:
    return models.agg(F.count(F.lit(1)).alias("total"),
                      F.count(F.when(F.col("problem_type") == "classification", 1)).alias("classification"),
                      F.count(F.when(F.col("problem_type") == "regression", 1)).alias("regression"))


def top_k(df: DataFrame, metric: str, k: int, tiebreak: str) -> DataFrame:
    """Top-k rows by a metric (ties by a key) -- a TakeOrdered, not a sort of everything."""
    return df.orderBy(qcol(metric).desc_nulls_last(), qcol(tiebreak)).limit(k)


def flag_updated_cells(df: DataFrame, updated: DataFrame, key: str) -> DataFrame:
    """Per displayed row, the array of columns whose cell changed (left join on the D2 table)."""
    changed = updated.groupBy(F.col("row_id").alias(key)).agg(F.sort_array(F.collect_list("column")).alias("updated_columns"))
    return df.join(changed, key, "left").withColumn(
        "updated_columns", F.coalesce(F.col("updated_columns"), F.array().cast("array<string>")))
