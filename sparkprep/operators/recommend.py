"""Recommenders R1-R17: rules evaluated over profile tables (one row per column
or one row per target), never over data rows.

Per-column rules are ``when``/``rlike`` chains on the profile DataFrame, so
the rule tables stay lazy and can be checked against SQL. Bundles that mix
several tables (``cleaning_suggestions``, ``analyze_dataset``,
``training_recommendations``) collect only those per-column rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import standardize_missing
from ..functions.types import is_numeric, qcol
from .profile import column_insights, first_values, duplicate_count, outlier_fences, outlier_table, target_analysis, target_classes

# ---------------------------------------------------------------- fixed values
NEAR_CONSTANT_SHARE = 0.01
DROP_MISSING_PCT = 80.0
ROW_DROP_SHARE = 0.03
OUTLIER_SUGGEST_PCT = 5.0
MEAN_HINTS = ("avg", "average", "mean", "ratio", "rate", "score", "percent")
MEDIAN_HINTS = ("amount", "price", "cost", "age", "income", "duration", "value", "size", "weight", "distance")
# extended (UI) rule set, as regular expressions over lower-case text
X_NUMERIC = "(int|float|double|decimal|number)"
X_BOOLEAN = "(bool)"
X_DATE = "(date|time|year|month)"
X_CATEGORICAL_NAME = "(id$|code$|type$|category|status|segment|group|class|flag|label)"
X_MEAN_NAME = "(avg|average|mean|ratio|rate|score|percent|percentage)"
X_MEDIAN_NAME = "(amount|price|cost|age|income|duration|time|value|size|weight|distance)"
REASONS = {
    "temporal": "Temporal/boolean fields resolve cleanly to the most frequent value",
    "rate": "Rate/score-like numeric series—mean preserves scale",
    "magnitude": "Magnitude-like numerics—median resists outliers",
    "numeric": "Default robust numeric imputation",
    "text": "Categorical/text is safest with the most frequent entry",
}
BASE_REASON = {
    "mean": "Stable numeric series where average preserves scale.",
    "median": "Resilient to spikes and skew in numeric data.",
    "mode": "Keeps the most common category for consistency.",
    "custom": "Best filled with a domain-specific default value.",
}
X_NUGGETS = {
    "date": "Temporal columns typically repeat calendar values; mode keeps the most common date/time.",
    "bool": "Boolean fields resolve cleanly to the majority class.",
    "mean": "Column name suggests calculated rates where averages stay meaningful.",
    "median": "Column tracks magnitudes that can spike; median resists outliers.",
    "id": "Identifier-like integers are better filled with the most common label.",
    "median_default": "Defaulting to median gives a sturdy central value for numeric columns.",
    "category": "Column behaves like a category; mode reinforces the prevailing class.",
    "text": "Text categorical data is safest imputed with the most frequent entry.",
    "custom": "Review this feature to decide on a domain-appropriate default.",
    "many_nulls": "Higher missing count – choose a robust technique.",
}
STEP_ORDER = {"encoding": 1, "scaling": 2, "feature_creation": 3, "binning": 4, "feature_selection": 5}


def _has_any(c: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


# ---------------------------------------------------------------- R6 / R7
def fill_strategy_exprs(name: Column, dtype: Column) -> tuple[Column, Column]:
    """R6 (backend rule set): strategy and reason from the column name and type."""
    n, t = F.lower(name), F.lower(dtype)
    numeric = t.rlike(X_NUMERIC)
    temporal = t.contains("date") | t.contains("time") | t.contains("bool")
    strategy = (F.when(temporal, "mode")
                .when(numeric & _has_any(n, MEAN_HINTS), "mean")
                .when(numeric, "median").otherwise("mode"))
    reason = (F.when(temporal, REASONS["temporal"])
              .when(numeric & _has_any(n, MEAN_HINTS), REASONS["rate"])
              .when(numeric & _has_any(n, MEDIAN_HINTS), REASONS["magnitude"])
              .when(numeric, REASONS["numeric"]).otherwise(REASONS["text"]))
    return strategy, reason


def fill_strategy_extended(name: Column, dtype: Column, null_count: Column) -> tuple[Column, Column]:
    """R7 (UI rule set): adds date-by-name, id-like integers -> mode, custom fallback."""
    n, t = F.lower(name), F.lower(dtype)
    numeric, boolean = t.rlike(X_NUMERIC), t.rlike(X_BOOLEAN)
    date = t.rlike(X_DATE) | n.rlike(X_DATE)
    cat_name = n.rlike(X_CATEGORICAL_NAME)
    hint = F.when(null_count > 10, F.lit(" " + X_NUGGETS["many_nulls"])).otherwise(F.lit(""))
    integer = t.contains("int") & ~t.contains("float")

    def r(strategy, nugget, with_hint=False):
        base = F.lit(f"{BASE_REASON[strategy]} {X_NUGGETS[nugget]}")
        return F.concat(base, hint) if with_hint else base

    cases = [(date, "mode", r("mode", "date")), (boolean, "mode", r("mode", "bool")),
             (numeric & n.rlike(X_MEAN_NAME), "mean", r("mean", "mean", True)),
             (numeric & n.rlike(X_MEDIAN_NAME), "median", r("median", "median", True)),
             (numeric & integer & cat_name, "mode", r("mode", "id", True)),
             (numeric, "median", r("median", "median_default", True)),
             (cat_name, "mode", r("mode", "category")),
             (t.contains("string") | (t == ""), "mode", r("mode", "text"))]
    strategy, reason = F.when(cases[0][0], cases[0][1]), F.when(cases[0][0], cases[0][2])
    for cond, s, why in cases[1:]:
        strategy, reason = strategy.when(cond, s), reason.when(cond, why)
    return strategy.otherwise("custom"), reason.otherwise(r("custom", "custom"))


# ---------------------------------------------------------------- R1-R5, R8
def cleaning_profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """Per column: position, dtype, rows, nulls, missing %, distinct, numeric flag."""
    t = column_insights(df, approx)
    pos = F.array_position(F.array(*[F.lit(c) for c in df.columns]), F.col("name")).cast("int")
    return t.select(pos.alias("pos"), F.col("name").alias("column"), "dtype", "cardinality", "missing_count",
                    "missing_percentage", (F.col("dtype").rlike("^(tinyint|smallint|int|bigint|float|double|decimal)")
                                           ).alias("is_numeric"))


def drop_candidates(profile: DataFrame, rows: int) -> DataFrame:
    """``(column, reason)``: >= 80 % missing, else near-constant (<= 1 % distinct)."""
    near = (F.col("cardinality") / F.lit(max(rows, 1)) <= NEAR_CONSTANT_SHARE) & F.lit(rows > 0)
    reason = (F.when(F.col("missing_percentage") >= DROP_MISSING_PCT,
                     F.concat(F.format_number(F.col("missing_percentage"), 1), F.lit("% missing")))
              .when(near, F.lit("Near-constant (<=1% unique)")))
    return profile.select("pos", "column", reason.alias("reason")).where(F.col("reason").isNotNull())


def fill_suggestions(profile: DataFrame, drops: DataFrame, extended: bool = False) -> DataFrame:
    """Strategy per column that has nulls and is not a drop candidate."""
    cand = profile.where(F.col("missing_count") > 0).join(drops.select("column"), "column", "left_anti")
    if extended:
        s, r = fill_strategy_extended(F.col("column"), F.col("dtype"), F.col("missing_count"))
    else:
        s, r = fill_strategy_exprs(F.col("column"), F.col("dtype"))
    return cand.select("pos", "column", s.alias("strategy"), r.alias("reason"))


def outlier_shares(df: DataFrame) -> DataFrame:
    """R2: outlier % per numeric column (1.5 IQR, strict, denominator all rows)."""
    nums = [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    fences = outlier_fences(df.select(*nums), factor=1.5) if nums else {}
    # every numeric column counts here, including mostly-null ones
    missing = [c for c in nums if c not in fences]
    if missing:
        from ..functions.quantiles import exact_quantiles
        for c, (q1, q3) in exact_quantiles(df, missing, [0.25, 0.75]).items():
            if q1 is not None:
                fences[c] = (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    return outlier_table(df, fences).select("column", "percentage")


def rows_with_any_null(df: DataFrame) -> DataFrame:
    """Rows with at least one null, and all rows."""
    anynull = F.lit(False)
    for c in df.columns:
        anynull = anynull | qcol(c).isNull()
    return df.agg(F.count(F.when(anynull, 1)).alias("null_rows"), F.count(F.lit(1)).alias("rows"))


# The texts in the next function are fixed values: they are part of the results to match.
def cleaning_suggestions(df: DataFrame, extended: bool = False, approx: bool = False) -> dict:
    """R1-R8 bundle (build_preprocessing_suggestions)."""
    df = standardize_missing(df)
    prof = cleaning_profile(df, approx).cache()
    try:
        rc = rows_with_any_null(df).collect()[0]
        rows, null_rows = rc["rows"], rc["null_rows"]
        drops = drop_candidates(prof, rows)
        drop_rows = drops.orderBy("pos").collect()
        fills = fill_suggestions(prof, drops, extended).orderBy("pos").collect()
        missing = {r["column"]: {"count": r["missing_count"], "percentage": r["missing_percentage"]}
                   for r in prof.where(F.col("missing_count") > 0).orderBy("pos").collect()}
    finally:
        prof.unpersist()
    dups = duplicate_count(df).collect()[0]["duplicate_rows"]
    outl = {r["column"]: {"percentage": r["percentage"]} for r in outlier_shares(df).collect() if r["percentage"] > 0}
    small = rows > 0 and null_rows / rows <= ROW_DROP_SHARE
    fill_cols = [r["column"] for r in fills]
    out_cols = [c for c, v in outl.items() if v["percentage"] > OUTLIER_SUGGEST_PCT]
    return {
        "removeDuplicates": {"enabled": dups > 0, "subset": [],
                             "reason": f"Found {dups} duplicate rows" if dups > 0 else "No duplicates"},
        "dropColumns": {"enabled": bool(drop_rows), "columns": [r["column"] for r in drop_rows],
                        "reason": "Columns with heavy missingness or near-constant variance",
                        "details": {r["column"]: {"reason": r["reason"]} for r in drop_rows}},
        "fillNulls": {"enabled": bool(fill_cols) and not small, "columns": fill_cols,
                      "strategies": {r["column"]: {"strategy": r["strategy"], "reason": r["reason"], "value": ""}
                                     for r in fills},
                      "reason": "Missing values detected; imputation preferred over row removal"},
        "removeNulls": {"enabled": small and null_rows > 0, "columns": fill_cols if small else [],
                        "reason": "Few rows contain nulls; dropping rows has low impact" if small
                        else "Row removal would be costly"},
        "removeOutliers": {"enabled": bool(out_cols), "method": "iqr", "factor": 1.5, "columns": out_cols,
                           "reason": "Outliers > 5% detected in some numeric columns" if out_cols
                           else "No significant outliers", "details": outl},
        "quality_summary": {"total_rows": rows, "total_columns": len(df.columns), "missing_data": missing,
                            "duplicate_rows": dups},
    }


# ---------------------------------------------------------------- R9-R12
def _names(t: DataFrame, cond: Column) -> Column:
    """Sorted-by-position names of profile rows matching ``cond`` (as an aggregate)."""
    return F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("pos", "name")))), lambda s: s["name"])


# The texts in the next function are fixed values: they are part of the results to match.
def step_recommendations(insights: DataFrame, n_columns: int) -> DataFrame:
    """``(step_type, step_name, columns, score, reason)`` in rule order."""
    t = insights
    num, cat = F.col("is_numeric"), F.col("is_categorical")
    agg = t.agg(
        _names(t, num & F.col("std_value").isNotNull() & (F.col("std_value") > 0)).alias("scaling"),
        _names(t, cat & (F.col("cardinality") >= 5) & (F.col("cardinality") <= 100)).alias("low"),
        _names(t, cat & (F.col("cardinality") > 100)).alias("high"),
        _names(t, num & F.col("max_value").isNotNull() & F.col("min_value").isNotNull()
               & ((F.col("max_value") - F.col("min_value")) > 100)).alias("binning"),
        _names(t, num).alias("numeric"),
        _names(t, cat & ~num).alias("categorical"),
        _names(t, F.col("is_datetime")).alias("datetime"))
    numeric3 = F.slice(F.col("numeric"), 1, 3)
    sel_cols = F.when(F.size("numeric") > 0, F.slice("numeric", 1, 5)).otherwise(F.slice("categorical", 1, 5))
    rows = [
        (1, "scaling", "Scaling", F.col("scaling"), 0.95,
         "Normalize numeric features to same scale for better model performance", F.size("scaling") > 0),
        (2, "encoding", "Encoding (Low-Cardinality Columns)", F.col("low"), 0.95,
         "Convert low-cardinality categorical variables to numerical format. ✓ Memory-safe", F.size("low") > 0),
        (3, "encoding", "⚠️ Encoding (High-Cardinality - Use Label Only!)", F.col("high"), 0.60,
         "⚠️ WARNING: These columns have MANY unique values. Use LABEL ENCODING ONLY (not one-hot) to avoid "
         "memory crash! One-hot would require 10s of GiB of RAM.", F.size("high") > 0),
        (4, "binning", "Binning", F.col("binning"), 0.75, "Convert continuous numeric features into discrete bins",
         F.size("binning") > 0),
        (5, "feature_creation", "Polynomial Features", numeric3, 0.80,
         "Create polynomial and interaction features for non-linear relationships", F.size("numeric") > 0),
        (6, "feature_creation", "DateTime Decomposition", F.col("datetime"), 0.90,
         "Extract temporal patterns (year, month, day, etc.) from datetime features", F.size("datetime") > 0),
        (7, "feature_selection", "Feature Selection", sel_cols, 0.70,
         "Remove low-variance or redundant features to reduce dimensionality", F.lit(n_columns > 10)),
    ]
    structs = [F.when(cond, F.struct(F.lit(i).alias("rank"), F.lit(k).alias("step_type"), F.lit(n).alias("step_name"),
                                     cols.alias("columns"), F.lit(s).alias("score"), F.lit(r).alias("reason")))
               for i, k, n, cols, s, r, cond in rows]
    return (agg.select(F.explode(F.filter(F.array(*structs), lambda x: x.isNotNull())).alias("r"))
            .select("r.*"))


def suggested_order(recs: DataFrame) -> DataFrame:
    """Step types in the fixed order encoding, scaling, creation, binning, selection."""
    order = F.create_map(*[x for k, v in STEP_ORDER.items() for x in (F.lit(k), F.lit(v))])
    return recs.select("step_type", "rank", F.coalesce(F.element_at(order, F.col("step_type")), F.lit(99))
                       .alias("order")).orderBy("order", "rank")


# The texts in the next function are fixed values: they are part of the results to match.
def quality_notes(insights: DataFrame) -> DataFrame:
    """One text row per triggered note, in rule order."""
    t = insights
    card = F.col("cardinality").cast("string")
    skew = (F.col("is_numeric") & F.col("mean_value").isNotNull() & F.col("std_value").isNotNull()
            & ((F.abs(F.col("mean_value") - F.col("min_value")) > 3 * F.col("std_value"))
               | (F.abs(F.col("max_value") - F.col("mean_value")) > 3 * F.col("std_value"))))

    def joined(cond, label=None):
        item = F.struct("pos", (F.concat(F.col("name"), F.lit(" ("), card, F.lit(" unique)")) if label
                                else F.col("name")).alias("txt"))
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, item))), lambda s: s["txt"]), ", ")

    agg = t.agg(joined(F.col("missing_percentage") > 30).alias("a"), joined(F.col("cardinality") == 1).alias("b"),
                joined(F.col("is_categorical") & (F.col("cardinality") > 1000), True).alias("c"),
                joined(F.col("is_categorical") & (F.col("cardinality") > 50) & (F.col("cardinality") <= 1000),
                       True).alias("d"),
                joined(skew).alias("e"))
    notes = [(1, "⚠️ High missing values (>30%): ", "a"), (2, "⚠️ Constant columns (no variance): ", "b"),
             (3, "🆔 ID/High-ID columns found - consider DROPPING these (not ML features): ", "c"),
             (4, "⚠️ High cardinality categorical (use LABEL encoding, not one-hot): ", "d"),
             (5, "📊 Skewed numeric features (consider scaling/transformation): ", "e")]
    arr = F.array(*[F.when(qcol(k) != "", F.struct(F.lit(i).alias("rank"), F.concat(F.lit(p), qcol(k)).alias("note")))
                    for i, p, k in notes])
    found = F.filter(arr, lambda x: x.isNotNull())
    ok = F.array(F.struct(F.lit(6).alias("rank"), F.lit("✅ Dataset looks good! No major data quality issues detected.")
                          .alias("note")))
    return agg.select(F.explode(F.when(F.size(found) > 0, found).otherwise(ok)).alias("n")).select("n.*")


def insights_with_position(df: DataFrame, approx: bool = False) -> DataFrame:
    pos = F.array_position(F.array(*[F.lit(c) for c in df.columns]), F.col("name")).cast("int")
    return column_insights(df, approx).withColumn("pos", pos)


def analyze_dataset(df: DataFrame, filename: str = "", approx: bool = False, row_key: str | None = None) -> dict:
    """Column insights + step suggestions + order + notes; with ``row_key`` also the
    first ten distinct values of each column in its order."""
    ins = insights_with_position(df, approx).cache()
    try:
        recs = step_recommendations(ins, len(df.columns))
        samples: dict[str, list] = {}
        if row_key:
            shown = [c for c in df.columns if c != row_key]
            parts = [first_values(df, c, row_key).select(F.lit(c).alias("column"), "value", F.col("_first").alias("first")) for c in shown]
            for r in reduce(DataFrame.unionByName, parts).orderBy("first").collect() if parts else []:  # at most ten a column
                samples.setdefault(r["column"], []).append(r["value"])
        return {"filename": filename, "total_rows": df.count(), "total_columns": len(df.columns),
                "column_insights": [{**r.asDict(), **({"sample_values": samples.get(r["name"], [])} if row_key else {})}
                                    for r in ins.orderBy("pos").collect()],
                "step_recommendations": [r.asDict() for r in recs.orderBy("rank").collect()],
                "suggested_pipeline": [r["step_type"] for r in suggested_order(recs).collect()],
                "data_quality_notes": [r["note"] for r in quality_notes(ins).orderBy("rank").collect()]}
    finally:
        ins.unpersist()


# ---------------------------------------------------------------- R14-R17
def problem_type(analysis: DataFrame) -> DataFrame:
    """R14 over the one-row target analysis."""
    dt = F.col("dtype")
    is_float = dt.rlike("^(float|double|decimal)")
    is_int = dt.rlike("^(tinyint|smallint|int|bigint)$")
    p = (F.when(dt == "string", "classification").when(F.col("is_boolean"), "classification")
         .when(is_float, "regression").when(F.col("unique_ratio") < 0.05, "classification")
         .when(is_int & (F.col("unique_values") <= 10), "classification").otherwise("regression"))
    return analysis.select("column_name", p.alias("problem_type"))


# The texts in the next function are fixed values: they are part of the results to match.
def target_validation(df: DataFrame, target: str) -> DataFrame:
    """One row with the list of validation errors (empty when valid)."""
    if target not in df.columns:
        return df.sparkSession.createDataFrame([([f"Target column '{target}' not found in dataset"],)],
                                               "errors array<string>")
    t = qcol(target)
    s = df.agg(F.count(F.when(t.isNull(), 1)).alias("n_null"), F.count(F.lit(1)).alias("n"),
               F.count_distinct(t).alias("d"))
    pct = F.col("n_null") * 100.0 / F.col("n")
    e1 = F.when(pct > 50, F.concat(F.lit(f"Target column '{target}' has "), F.format_number(pct, 1),
                                   F.lit("% null values. Please clean this column before training.")))
    e2 = F.when(F.col("d") == 1, F.lit(f"Target column '{target}' has only one unique value. "
                                       "Cannot train a model with constant target."))
    return s.select(F.filter(F.array(e1, e2), lambda x: x.isNotNull()).alias("errors"))


# The texts in the next function are fixed values: they are part of the results to match.
def model_recommendations(ptype: DataFrame, n_samples: Column, n_features: Column) -> DataFrame:
    """Rows ``(model_id, model_name, reason, recommended, priority)`` in rule order.
    ``ptype`` has one row with ``problem_type``; counts are columns of it."""
    cls = F.col("problem_type") == "classification"
    big, huge, wide = n_samples >= 1000, n_samples >= 10000, n_features >= 20
    ns, nf = n_samples.cast("string"), n_features.cast("string")

    def rec(i, mid, name, reason, recommended, priority, cond=F.lit(True)):
        return F.when(cond, F.struct(F.lit(i).alias("rank"), F.lit(mid).alias("model_id"), F.lit(name).alias("model_name"),
                                     reason.alias("reason") if isinstance(reason, Column) else F.lit(reason).alias("reason"),
                                     recommended.alias("recommended") if isinstance(recommended, Column)
                                     else F.lit(recommended).alias("recommended"),
                                     priority.alias("priority") if isinstance(priority, Column)
                                     else F.lit(priority).alias("priority")))

    def pick(c, a, b):
        return F.when(c, a).otherwise(b)

    items = [
        rec(1, "logistic_regression", "Logistic Regression", "Fast, interpretable baseline for classification", True, "high", cls),
        rec(1, "linear_regression", "Linear Regression", "Fast, interpretable baseline for regression", True, "high", ~cls),
        rec(2, "random_forest", "Random Forest", pick(cls, F.lit("Robust ensemble method, handles non-linear relationships well"),
                                                     F.lit("Handles non-linear relationships and outliers well")), True, "high"),
        rec(3, "gradient_boosting", "Gradient Boosting", pick(cls, F.lit("Solid ensemble method for classification"),
                                                             F.lit("Solid ensemble method for regression")), True, "high"),
        rec(4, "xgboost", "XGBoost",
            pick(big, pick(cls, F.concat(F.lit("Powerful gradient boosting for large datasets ("), ns, F.lit(" samples)")),
                           F.concat(F.lit("Powerful for large datasets ("), ns, F.lit(" samples)"))),
                 pick(cls, F.lit("Good but may overfit on small datasets"), F.lit("May overfit on small datasets"))),
            big, pick(big, F.lit("high"), F.lit("medium"))),
        rec(5, "lightgbm", "LightGBM",
            pick(huge, pick(cls, F.concat(F.lit("Fast training on large datasets ("), ns, F.lit(" samples)")),
                            F.concat(F.lit("Fastest for large datasets ("), ns, F.lit(" samples)"))),
                 F.lit("Better suited for larger datasets")),
            huge, pick(huge, F.lit("high"), F.lit("low"))),
        rec(6, "ridge", "Ridge Regression",
            pick(wide, F.concat(F.lit("Good regularization for high-dimensional data ("), nf, F.lit(" features)")),
                 F.lit("Regularized linear model")), wide, pick(wide, F.lit("medium"), F.lit("low")), ~cls),
        rec(7, "lasso", "Lasso Regression",
            pick(wide, F.concat(F.lit("Feature selection through L1 regularization ("), nf, F.lit(" features)")),
                 F.lit("L1 regularized linear model")), wide, pick(wide, F.lit("medium"), F.lit("low")), ~cls),
    ]
    return ptype.select(F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("m")).select("m.*")


def training_recommendations(df: DataFrame, target: str) -> dict:
    """Target analysis with its class table + problem type + model list."""
    ta = target_analysis(df, target)
    pt = problem_type(ta).join(ta.select("column_name", "total_samples"), "column_name")
    n_features = len(df.columns) - 1
    models = model_recommendations(pt, F.col("total_samples"), F.lit(n_features))
    row = pt.collect()[0]
    classes = {r["value"]: r["count"] for r in target_classes(df, target).collect()}  # at most ten
    return {"target_analysis": {**ta.collect()[0].asDict(), **({"class_distribution": classes} if classes else {})}, "problem_type": row["problem_type"],
            "recommended_models": [r.asDict() for r in models.orderBy("rank").collect()],
            "n_samples": row["total_samples"], "n_features": n_features}


# ---------------------------------------------------------------- R13
STEP_RULES = ("scaling", "encoding", "binning", "polynomial", "datetime_decomposition", "feature_selection")


# The texts in the next function are fixed values: they are part of the results to match.
def column_eligibility(df: DataFrame) -> DataFrame:
    """Per (column, step) whether the column suits the step, why, and the
    suggested method (encoding: one-hot up to 100 distinct values, else label)."""
    from ..functions.types import is_datetime as _is_dt
    from .profile import column_profile
    kinds = {f.name: ("numeric" if is_numeric(f.dataType) else "datetime" if _is_dt(f.dataType) else "other")
             for f in df.schema.fields}
    kind = F.element_at(F.create_map(*[x for k, v in kinds.items() for x in (F.lit(k), F.lit(v))]), F.col("column"))
    prof = column_profile(df).select("column", "null_count", "distinct_count", kind.alias("kind"))
    num, dt = F.col("kind") == "numeric", F.col("kind") == "datetime"
    nulls = F.col("null_count").cast("string")
    rules = {
        "scaling": (num, F.when(~num, F.lit("Cannot scale non-numeric columns"))
                    .when(F.col("null_count") > 0, F.concat(F.lit("Numeric column ("), nulls, F.lit(" nulls) - good for scaling")))
                    .otherwise(F.lit("Numeric column - good for scaling")), F.lit("standard")),
        "encoding": (~num & ~dt, F.when(num, F.lit("Already numeric - no encoding needed"))
                     .when(dt, F.lit("Use DateTime Decomposition instead"))
                     .when(F.col("null_count") > 0, F.concat(F.lit("Categorical/Text column ("), nulls,
                                                            F.lit(" nulls) - good for encoding")))
                     .otherwise(F.lit("Categorical/Text column - good for encoding")),
                     F.when(F.col("distinct_count") <= 100, F.lit("one-hot")).otherwise(F.lit("label"))),
        "binning": (num, F.when(~num, F.lit("Cannot bin non-numeric columns"))
                    .otherwise(F.lit("Numeric column - good for binning")), F.lit("equal-width")),
        "polynomial": (num, F.when(~num, F.lit("Cannot create polynomial features from non-numeric columns"))
                       .otherwise(F.lit("Numeric column - good for polynomial expansion")), F.lit(None).cast("string")),
        "datetime_decomposition": (dt, F.when(~dt, F.lit("Only datetime columns can be decomposed"))
                                   .otherwise(F.lit("DateTime column - good for decomposition")),
                                   F.lit(None).cast("string")),
        "feature_selection": (num, F.when(~num, F.lit("Feature selection works best on numeric features"))
                              .otherwise(F.lit("Numeric feature - good for selection")), F.lit(None).cast("string")),
    }
    arr = F.array(*[F.struct(F.lit(step).alias("step"), valid.alias("is_valid"), why.alias("reason"),
                             sug.alias("suggestion")) for step, (valid, why, sug) in rules.items()])
    return prof.select("column", F.explode(arr).alias("r")).select("column", "r.*")
