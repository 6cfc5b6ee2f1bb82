"""Recommender queries (R1-R17): rule tables over per-column profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import clean_events, clean_events_sql, table
from ..operators import recommend as R
from ..operators.profile import target_analysis
from . import query, r6

W = "WITH " + clean_events_sql()

# driver-table schemas used to generate the SQL twins (name, spark type)
SCHEMAS = {
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"),
                 ("c_mktsegment", "string")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")],
    "labels": [("doc_id", "bigint"), ("quality", "int"), ("toxic", "int")],
    "clean_events": [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"),
                     ("event_type", "string"), ("value", "double"), ("props", "string")],
}
NUMERIC_TYPES = ("bigint", "int", "double")


def _source(spark, sf, name):
    if name == "clean_events":
        return clean_events(spark, sf).drop("row_id")
    return table(spark, sf, name)


class T:
    """Fixed values of the rules, written out on their own for the oracles."""
    MEAN_HINTS = ("avg", "average", "mean", "ratio", "rate", "score", "percent")
    MEDIAN_HINTS = ("amount", "price", "cost", "age", "income", "duration", "value", "size", "weight", "distance")
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


def _sql_list(words) -> str:
    return " OR ".join(f"contains(n, '{w}')" for w in words)


def _rule_sql(extended: bool) -> str:
    if not extended:
        num = "regexp_matches(t, '(int|float|double|decimal|number)')"
        temporal = "(contains(t, 'date') OR contains(t, 'time') OR contains(t, 'bool'))"
        strat = (f"CASE WHEN {temporal} THEN 'mode' WHEN {num} AND ({_sql_list(T.MEAN_HINTS)}) THEN 'mean' "
                 f"WHEN {num} THEN 'median' ELSE 'mode' END")
        why = (f"CASE WHEN {temporal} THEN '{T.REASONS['temporal']}' "
               f"WHEN {num} AND ({_sql_list(T.MEAN_HINTS)}) THEN '{T.REASONS['rate']}' "
               f"WHEN {num} AND ({_sql_list(T.MEDIAN_HINTS)}) THEN '{T.REASONS['magnitude']}' "
               f"WHEN {num} THEN '{T.REASONS['numeric']}' ELSE '{T.REASONS['text']}' END")
        return f"{strat} AS strategy, {why} AS reason"
    num, boo = f"regexp_matches(t, '{T.X_NUMERIC}')", f"regexp_matches(t, '{T.X_BOOLEAN}')"
    date = f"(regexp_matches(t, '{T.X_DATE}') OR regexp_matches(n, '{T.X_DATE}'))"
    catn = f"regexp_matches(n, '{T.X_CATEGORICAL_NAME}')"
    integer = "(contains(t, 'int') AND NOT contains(t, 'float'))"
    hint = f"CASE WHEN nulls > 10 THEN ' {T.X_NUGGETS['many_nulls']}' ELSE '' END"

    def rr(s, k, h=False):
        base = f"'{T.BASE_REASON[s]} {T.X_NUGGETS[k]}'"
        return f"{base} || {hint}" if h else base
    cases = [(date, "mode", rr("mode", "date")), (boo, "mode", rr("mode", "bool")),
             (f"{num} AND regexp_matches(n, '{T.X_MEAN_NAME}')", "mean", rr("mean", "mean", True)),
             (f"{num} AND regexp_matches(n, '{T.X_MEDIAN_NAME}')", "median", rr("median", "median", True)),
             (f"{num} AND {integer} AND {catn}", "mode", rr("mode", "id", True)),
             (num, "median", rr("median", "median_default", True)), (catn, "mode", rr("mode", "category")),
             ("(contains(t, 'string') OR t = '')", "mode", rr("mode", "text"))]
    strat = "CASE " + " ".join(f"WHEN {c} THEN '{s}'" for c, s, _ in cases) + " ELSE 'custom' END"
    why = "CASE " + " ".join(f"WHEN {c} THEN {w}" for c, _, w in cases) + f" ELSE {rr('custom', 'custom')} END"
    return f"{strat} AS strategy, {why} AS reason"


def _null_profile_sql(tables) -> str:
    parts = []
    for tb in tables:
        for c, t in SCHEMAS[tb]:
            parts.append(f"SELECT '{tb}' AS tbl, '{c}' AS \"column\", lower('{t}') AS t, lower('{c}') AS n, "
                         f"count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM {tb}")
    return "p AS (" + "\nUNION ALL ".join(parts) + ")"


RULE_TABLES = ["customer", "orders", "labels", "clean_events"]


def _null_profile(spark, sf):
    out = None
    for tb in RULE_TABLES:
        df = _source(spark, sf, tb)
        body = ", ".join(f"'{f.name}', '{f.dataType.simpleString()}', `_n{i}`" for i, f in enumerate(df.schema.fields))
        p = (df.agg(*[F.count(F.when(F.col(f.name).isNull(), 1)).alias(f"_n{i}") for i, f in enumerate(df.schema.fields)])
             .selectExpr(f"stack({len(df.columns)}, {body}) as (column, dtype, nulls)")
             .withColumn("tbl", F.lit(tb)))
        out = p if out is None else out.unionByName(p)
    return out


@query("fill_strategy", W + ",\n" + _null_profile_sql(RULE_TABLES) +
       f"\nSELECT tbl, \"column\", {_rule_sql(False)} FROM p")
def q_fill_strategy(spark, sf):
    p = _null_profile(spark, sf)
    s, r = R.fill_strategy_exprs(F.col("column"), F.col("dtype"))
    return p.select("tbl", "column", s.alias("strategy"), r.alias("reason"))


@query("fill_strategy_extended", W + ",\n" + _null_profile_sql(RULE_TABLES) +
       f"\nSELECT tbl, \"column\", {_rule_sql(True)} FROM p")
def q_fill_strategy_extended(spark, sf):
    p = _null_profile(spark, sf)
    s, r = R.fill_strategy_extended(F.col("column"), F.col("dtype"), F.col("nulls"))
    return p.select("tbl", "column", s.alias("strategy"), r.alias("reason"))


def _drop_sql() -> str:
    parts = [f"SELECT {i + 1} AS pos, '{c}' AS \"column\", count(DISTINCT {c}) AS d, "
             f"100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*) AS m, count(*) AS n FROM clean_events"
             for i, (c, _) in enumerate(SCHEMAS["clean_events"])]
    return W + ", p AS (" + "\nUNION ALL ".join(parts) + """)
SELECT pos, "column", CASE WHEN m >= 80 THEN printf('%.1f', m) || '% missing'
  ELSE 'Near-constant (<=1% unique)' END AS reason FROM p WHERE m >= 80 OR d / n <= 0.01"""


@query("suggest_drop_columns", _drop_sql())
def q_suggest_drop_columns(spark, sf):
    df = _source(spark, sf, "clean_events")
    rows = df.count()
    return R.drop_candidates(R.cleaning_profile(df), rows)


@query("outlier_shares", W + """,
f AS (SELECT 'event_id' AS c, quantile_cont(event_id, 0.25) AS q1, quantile_cont(event_id, 0.75) AS q3 FROM clean_events
      UNION ALL SELECT 'user_id', quantile_cont(user_id, 0.25), quantile_cont(user_id, 0.75) FROM clean_events
      UNION ALL SELECT 'value', quantile_cont(value, 0.25), quantile_cont(value, 0.75) FROM clean_events),
b AS (SELECT c, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM f)
SELECT 'event_id' AS "column", round(100.0 * count(*) FILTER (WHERE event_id < (SELECT lo FROM b WHERE c = 'event_id')
  OR event_id > (SELECT hi FROM b WHERE c = 'event_id')) / count(*), 6) AS percentage FROM clean_events
UNION ALL SELECT 'user_id', round(100.0 * count(*) FILTER (WHERE user_id < (SELECT lo FROM b WHERE c = 'user_id')
  OR user_id > (SELECT hi FROM b WHERE c = 'user_id')) / count(*), 6) FROM clean_events
UNION ALL SELECT 'value', round(100.0 * count(*) FILTER (WHERE value < (SELECT lo FROM b WHERE c = 'value')
  OR value > (SELECT hi FROM b WHERE c = 'value')) / count(*), 6) FROM clean_events""")
def q_outlier_shares(spark, sf):
    return R.outlier_shares(_source(spark, sf, "clean_events")).withColumn("percentage", r6(F.col("percentage")))


@query("rows_with_nulls", W + """
SELECT count(*) FILTER (WHERE event_type IS NULL OR value IS NULL OR props IS NULL OR ts IS NULL
                        OR user_id IS NULL OR event_id IS NULL) AS null_rows, count(*) AS rows FROM clean_events""")
def q_rows_with_nulls(spark, sf):
    return R.rows_with_any_null(_source(spark, sf, "clean_events"))


@query("suggest_cleaning", W + """,
p AS (SELECT 1 AS pos, 'event_id' AS c, count(DISTINCT event_id) AS d, count(*) FILTER (WHERE event_id IS NULL) AS nn, count(*) AS n FROM clean_events
UNION ALL SELECT 2 AS pos, 'ts' AS c, count(DISTINCT ts) AS d, count(*) FILTER (WHERE ts IS NULL) AS nn, count(*) AS n FROM clean_events
UNION ALL SELECT 3 AS pos, 'user_id' AS c, count(DISTINCT user_id) AS d, count(*) FILTER (WHERE user_id IS NULL) AS nn, count(*) AS n FROM clean_events
UNION ALL SELECT 4 AS pos, 'event_type' AS c, count(DISTINCT event_type) AS d, count(*) FILTER (WHERE event_type IS NULL) AS nn, count(*) AS n FROM clean_events
UNION ALL SELECT 5 AS pos, 'value' AS c, count(DISTINCT value) AS d, count(*) FILTER (WHERE value IS NULL) AS nn, count(*) AS n FROM clean_events
UNION ALL SELECT 6 AS pos, 'props' AS c, count(DISTINCT props) AS d, count(*) FILTER (WHERE props IS NULL) AS nn, count(*) AS n FROM clean_events),
f AS (SELECT 1 AS pos, 'event_id' AS c, quantile_cont(event_id, 0.25) AS q1, quantile_cont(event_id, 0.75) AS q3 FROM clean_events
UNION ALL SELECT 2 AS pos, 'user_id' AS c, quantile_cont(user_id, 0.25) AS q1, quantile_cont(user_id, 0.75) AS q3 FROM clean_events
UNION ALL SELECT 3 AS pos, 'value' AS c, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM clean_events),
o AS (SELECT 'event_id' AS c, 100.0 * count(*) FILTER (WHERE event_id < (SELECT q1 - 1.5 * (q3 - q1) FROM f WHERE c = 'event_id') OR event_id > (SELECT q3 + 1.5 * (q3 - q1) FROM f WHERE c = 'event_id')) / count(*) AS pct FROM clean_events
UNION ALL SELECT 'user_id' AS c, 100.0 * count(*) FILTER (WHERE user_id < (SELECT q1 - 1.5 * (q3 - q1) FROM f WHERE c = 'user_id') OR user_id > (SELECT q3 + 1.5 * (q3 - q1) FROM f WHERE c = 'user_id')) / count(*) AS pct FROM clean_events
UNION ALL SELECT 'value' AS c, 100.0 * count(*) FILTER (WHERE value < (SELECT q1 - 1.5 * (q3 - q1) FROM f WHERE c = 'value') OR value > (SELECT q3 + 1.5 * (q3 - q1) FROM f WHERE c = 'value')) / count(*) AS pct FROM clean_events),
dr AS (SELECT pos, c FROM p WHERE 100.0 * nn / n >= 80 OR d / n <= 0.01),
fl AS (SELECT pos, c FROM p WHERE nn > 0 AND c NOT IN (SELECT c FROM dr)),
oc AS (SELECT f.pos, o.c FROM o JOIN f USING (c) WHERE pct > 5),
g AS (SELECT count(*) FILTER (WHERE event_id IS NULL OR ts IS NULL OR user_id IS NULL OR event_type IS NULL OR value IS NULL OR props IS NULL) AS null_rows, count(*) AS rows FROM clean_events),
dup AS (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * EXCLUDE (row_id) FROM clean_events)) AS k
        FROM clean_events),
sm AS (SELECT rows > 0 AND null_rows / rows <= 0.03 AS small, null_rows FROM g)
SELECT 'removeDuplicates' AS section, k > 0 AS enabled, []::VARCHAR[] AS columns,
       CASE WHEN k > 0 THEN 'Found ' || k || ' duplicate rows' ELSE 'No duplicates' END AS reason FROM dup
UNION ALL SELECT 'dropColumns', (SELECT count(*) FROM dr) > 0, coalesce((SELECT list(c ORDER BY pos) FROM dr), []),
       'Columns with heavy missingness or near-constant variance'
UNION ALL SELECT 'fillNulls', (SELECT count(*) FROM fl) > 0 AND NOT small, coalesce((SELECT list(c ORDER BY pos) FROM fl), []),
       'Missing values detected; imputation preferred over row removal' FROM sm
UNION ALL SELECT 'removeNulls', small AND null_rows > 0,
       CASE WHEN small THEN coalesce((SELECT list(c ORDER BY pos) FROM fl), []) ELSE []::VARCHAR[] END,
       CASE WHEN small THEN 'Few rows contain nulls; dropping rows has low impact' ELSE 'Row removal would be costly' END
       FROM sm
UNION ALL SELECT 'removeOutliers', (SELECT count(*) FROM oc) > 0, coalesce((SELECT list(c ORDER BY pos) FROM oc), []),
       CASE WHEN (SELECT count(*) FROM oc) > 0 THEN 'Outliers > 5% detected in some numeric columns'
            ELSE 'No significant outliers' END""")
def q_suggest_cleaning(spark, sf):
    s = R.cleaning_suggestions(_source(spark, sf, "clean_events"))
    rows = [(k, bool(v["enabled"]), list(v.get("columns", v.get("subset", []))), v["reason"])
            for k, v in s.items() if k != "quality_summary"]
    return spark.createDataFrame(rows, "section string, enabled boolean, columns array<string>, reason string")


def _insight_sql(tb: str, src: str | None = None) -> str:
    parts = []
    for i, (c, t) in enumerate(SCHEMAS[tb]):
        num = t in NUMERIC_TYPES
        stats = f"min({c})::DOUBLE, max({c})::DOUBLE, avg({c})::DOUBLE, stddev_samp({c})::DOUBLE" if num \
            else "NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE"
        parts.append(f"SELECT {i + 1} AS pos, '{c}' AS name, {str(num).lower()} AS is_num, "
                     f"{str(t == 'string').lower()} AS is_cat, {str(t.startswith('timestamp')).lower()} AS is_dt, "
                     f"count(DISTINCT {c}) AS card, 100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*) AS miss, "
                     f"{stats} FROM {src or tb}")
    return ("i(pos, name, is_num, is_cat, is_dt, card, miss, lo, hi, mu, sd) AS ("
            + "\nUNION ALL ".join(parts) + ")")


def _steps_sql(tb: str) -> str:
    n_cols = len(SCHEMAS[tb])
    L = lambda cond: f"coalesce(list(name ORDER BY pos) FILTER (WHERE {cond}), [])"
    rules = [
        (1, "scaling", "Scaling", "sc", "0.95", "Normalize numeric features to same scale for better model performance"),
        (2, "encoding", "Encoding (Low-Cardinality Columns)", "lo_c", "0.95",
         "Convert low-cardinality categorical variables to numerical format. ✓ Memory-safe"),
        (3, "encoding", "⚠️ Encoding (High-Cardinality - Use Label Only!)", "hi_c", "0.60",
         "⚠️ WARNING: These columns have MANY unique values. Use LABEL ENCODING ONLY (not one-hot) to avoid memory "
         "crash! One-hot would require 10s of GiB of RAM."),
        (4, "binning", "Binning", "bn", "0.75", "Convert continuous numeric features into discrete bins"),
        (5, "feature_creation", "Polynomial Features", "nm[1:3]", "0.80",
         "Create polynomial and interaction features for non-linear relationships"),
        (6, "feature_creation", "DateTime Decomposition", "dt", "0.90",
         "Extract temporal patterns (year, month, day, etc.) from datetime features"),
        (7, "feature_selection", "Feature Selection", "CASE WHEN len(nm) > 0 THEN nm[1:5] ELSE ct[1:5] END", "0.70",
         "Remove low-variance or redundant features to reduce dimensionality"),
    ]
    conds = {1: "len(sc) > 0", 2: "len(lo_c) > 0", 3: "len(hi_c) > 0", 4: "len(bn) > 0", 5: "len(nm) > 0",
             6: "len(dt) > 0", 7: f"{str(n_cols > 10).lower()}"}
    sel = "\nUNION ALL ".join(
        f"SELECT {k} AS rank, '{t}' AS step_type, '{n}' AS step_name, {col} AS columns, CAST({s} AS DOUBLE) AS score, "
        f"'{why}' AS reason FROM a WHERE {conds[k]}" for k, t, n, col, s, why in rules)
    return (f"WITH {_insight_sql(tb)},\na AS (SELECT {L('is_num AND sd > 0')} AS sc, "
            f"{L('is_cat AND card BETWEEN 5 AND 100')} AS lo_c, {L('is_cat AND card > 100')} AS hi_c, "
            f"{L('is_num AND hi - lo > 100')} AS bn, {L('is_num')} AS nm, {L('is_cat AND NOT is_num')} AS ct, "
            f"{L('is_dt')} AS dt FROM i)\n{sel}")


@query("suggest_steps", _steps_sql("orders"))
def q_suggest_steps(spark, sf):
    df = table(spark, sf, "orders")
    return R.step_recommendations(R.insights_with_position(df), len(df.columns))


@query("suggested_order", _steps_sql("orders").replace("\nSELECT 1 AS rank", ",\nr AS (SELECT 1 AS rank", 1) + """)
SELECT step_type, rank, CASE step_type WHEN 'encoding' THEN 1 WHEN 'scaling' THEN 2 WHEN 'feature_creation' THEN 3
  WHEN 'binning' THEN 4 WHEN 'feature_selection' THEN 5 ELSE 99 END AS "order" FROM r""")
def q_suggested_order(spark, sf):
    df = table(spark, sf, "orders")
    return R.suggested_order(R.step_recommendations(R.insights_with_position(df), len(df.columns)))


def _notes_sql(tb: str) -> str:
    J = lambda cond, lab=False: (
        f"coalesce(string_agg({'name || ' + chr(39) + ' (' + chr(39) + ' || card || ' + chr(39) + ' unique)' + chr(39) if lab else 'name'}, ', ' ORDER BY pos) FILTER (WHERE {cond}), '')")
    skew = "is_num AND mu IS NOT NULL AND sd IS NOT NULL AND (abs(mu - lo) > 3 * sd OR abs(hi - mu) > 3 * sd)"
    notes = [(1, "⚠️ High missing values (>30%): ", "a"), (2, "⚠️ Constant columns (no variance): ", "b"),
             (3, "🆔 ID/High-ID columns found - consider DROPPING these (not ML features): ", "c"),
             (4, "⚠️ High cardinality categorical (use LABEL encoding, not one-hot): ", "d"),
             (5, "📊 Skewed numeric features (consider scaling/transformation): ", "e")]
    sel = "\nUNION ALL ".join(f"SELECT {i} AS rank, '{p}' || {k} AS note FROM g WHERE {k} <> ''" for i, p, k in notes)
    return (f"WITH {_insight_sql(tb)},\ng AS (SELECT {J('miss > 30')} AS a, {J('card = 1')} AS b, "
            f"{J('is_cat AND card > 1000', True)} AS c, {J('is_cat AND card > 50 AND card <= 1000', True)} AS d, "
            f"{J(skew)} AS e FROM i),\nf AS ({sel})\nSELECT * FROM f UNION ALL "
            "SELECT 6, '✅ Dataset looks good! No major data quality issues detected.' WHERE (SELECT count(*) FROM f) = 0")


@query("quality_notes", _notes_sql("customer"))
def q_quality_notes(spark, sf):
    return R.quality_notes(R.insights_with_position(table(spark, sf, "customer")))


@query("quality_notes_clean", _notes_sql("labels"))
def q_quality_notes_clean(spark, sf):
    return R.quality_notes(R.insights_with_position(table(spark, sf, "labels")))


TARGETS = [("labels", "quality", "int"), ("lineitem", "l_extendedprice", "double"), ("orders", "o_orderstatus", "string"),
           ("lineitem", "l_linenumber", "int"), ("customer", "c_nationkey", "int"), ("customer", "c_custkey", "bigint")]


def _ptype_sql() -> str:
    parts = []
    for tb, c, t in TARGETS:
        if t == "string":
            parts.append(f"SELECT '{c}' AS column_name, 'classification' AS problem_type FROM {tb} LIMIT 1")
            continue
        boolean = f"count(*) FILTER (WHERE {c} IS NOT NULL AND {c} NOT IN (0, 1)) = 0"
        ratio = f"count(DISTINCT {c}) / count({c})"
        rule = (f"CASE WHEN {boolean} THEN 'classification' WHEN {str(t == 'double').lower()} THEN 'regression' "
                f"WHEN {ratio} < 0.05 THEN 'classification' WHEN count(DISTINCT {c}) <= 10 THEN 'classification' "
                f"ELSE 'regression' END")
        parts.append(f"SELECT '{c}' AS column_name, {rule} AS problem_type FROM {tb}")
    return "\nUNION ALL ".join(f"({p})" for p in parts)


@query("problem_type", _ptype_sql())
def q_problem_type(spark, sf):
    out = None
    for tb, c, _ in TARGETS:
        p = R.problem_type(target_analysis(table(spark, sf, tb), c))
        out = p if out is None else out.unionByName(p)
    return out


VALIDATE = [("clean_events", "value"), ("clean_events", "event_type"), ("labels", "quality")]


def _validate_sql() -> str:
    parts = []
    for tb, c in VALIDATE:
        pct = f"count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*)"
        parts.append(f"SELECT '{c}' AS target, list_filter([CASE WHEN {pct} > 50 THEN 'Target column ''{c}'' has ' || "
                     f"printf('%.1f', {pct}) || '% null values. Please clean this column before training.' END, "
                     f"CASE WHEN count(DISTINCT {c}) = 1 THEN 'Target column ''{c}'' has only one unique value. "
                     f"Cannot train a model with constant target.' END], lambda x: x IS NOT NULL) AS errors FROM {tb}")
    parts.append("SELECT 'is_long', list_filter([CASE WHEN count(DISTINCT n_chars > 0) = 1 THEN 'Target column ''is_long'' "
                 "has only one unique value. Cannot train a model with constant target.' END], lambda x: x IS NOT NULL) "
                 "FROM documents")
    return W + "\n" + "\nUNION ALL ".join(parts)


@query("target_validation", _validate_sql())
def q_target_validation(spark, sf):
    out = None
    for tb, c in VALIDATE:
        v = R.target_validation(_source(spark, sf, tb), c).select(F.lit(c).alias("target"), "errors")
        out = v if out is None else out.unionByName(v)
    docs = table(spark, sf, "documents").select((F.col("n_chars") > 0).alias("is_long"))
    return out.unionByName(R.target_validation(docs, "is_long").select(F.lit("is_long").alias("target"), "errors"))


def _models_sql(tb: str, target: str, n_features: int, cls: bool) -> str:
    n = f"(SELECT count({target}) FROM {tb})"
    ns = f"CAST({n} AS VARCHAR)"
    rows = []
    if cls:
        rows += [("1", "'logistic_regression'", "'Logistic Regression'", "'Fast, interpretable baseline for classification'",
                  "true", "'high'"),
                 ("2", "'random_forest'", "'Random Forest'", "'Robust ensemble method, handles non-linear relationships well'",
                  "true", "'high'"),
                 ("3", "'gradient_boosting'", "'Gradient Boosting'", "'Solid ensemble method for classification'", "true",
                  "'high'"),
                 ("4", "'xgboost'", "'XGBoost'", f"CASE WHEN {n} >= 1000 THEN 'Powerful gradient boosting for large "
                  f"datasets (' || {ns} || ' samples)' ELSE 'Good but may overfit on small datasets' END",
                  f"{n} >= 1000", f"CASE WHEN {n} >= 1000 THEN 'high' ELSE 'medium' END"),
                 ("5", "'lightgbm'", "'LightGBM'", f"CASE WHEN {n} >= 10000 THEN 'Fast training on large datasets (' || "
                  f"{ns} || ' samples)' ELSE 'Better suited for larger datasets' END", f"{n} >= 10000",
                  f"CASE WHEN {n} >= 10000 THEN 'high' ELSE 'low' END")]
    else:
        wide = n_features >= 20
        rows += [("1", "'linear_regression'", "'Linear Regression'", "'Fast, interpretable baseline for regression'",
                  "true", "'high'"),
                 ("2", "'random_forest'", "'Random Forest'", "'Handles non-linear relationships and outliers well'",
                  "true", "'high'"),
                 ("3", "'gradient_boosting'", "'Gradient Boosting'", "'Solid ensemble method for regression'", "true",
                  "'high'"),
                 ("4", "'xgboost'", "'XGBoost'", f"CASE WHEN {n} >= 1000 THEN 'Powerful for large datasets (' || {ns} || "
                  f"' samples)' ELSE 'May overfit on small datasets' END", f"{n} >= 1000",
                  f"CASE WHEN {n} >= 1000 THEN 'high' ELSE 'medium' END"),
                 ("5", "'lightgbm'", "'LightGBM'", f"CASE WHEN {n} >= 10000 THEN 'Fastest for large datasets (' || {ns} || "
                  f"' samples)' ELSE 'Better suited for larger datasets' END", f"{n} >= 10000",
                  f"CASE WHEN {n} >= 10000 THEN 'high' ELSE 'low' END"),
                 ("6", "'ridge'", "'Ridge Regression'",
                  f"'Good regularization for high-dimensional data ({n_features} features)'" if wide
                  else "'Regularized linear model'", str(wide).lower(), "'medium'" if wide else "'low'"),
                 ("7", "'lasso'", "'Lasso Regression'",
                  f"'Feature selection through L1 regularization ({n_features} features)'" if wide
                  else "'L1 regularized linear model'", str(wide).lower(), "'medium'" if wide else "'low'")]
    return "\nUNION ALL ".join(f"SELECT '{target}' AS target, {a} AS rank, {b} AS model_id, {c} AS model_name, "
                               f"{d} AS reason, {e} AS recommended, {f} AS priority" for a, b, c, d, e, f in rows)


@query("model_recommendations", _models_sql("labels", "quality", 2, True) + "\nUNION ALL "
       + _models_sql("lineitem", "l_extendedprice", 10, False))
def q_model_recommendations(spark, sf):
    out = None
    for tb, c in (("labels", "quality"), ("lineitem", "l_extendedprice")):
        df = table(spark, sf, tb)
        ta = target_analysis(df, c)
        pt = R.problem_type(ta).join(ta.select("column_name", "total_samples"), "column_name")
        m = R.model_recommendations(pt, F.col("total_samples"), F.lit(len(df.columns) - 1)) \
            .select(F.lit(c).alias("target"), "*")
        out = m if out is None else out.unionByName(m)
    return out


def _eligibility_sql(tb: str, src: str) -> str:
    parts = []
    for c, t in SCHEMAS[tb]:
        kind = "numeric" if t in NUMERIC_TYPES else "datetime" if t.startswith("timestamp") else "other"
        parts.append(f"SELECT '{c}' AS \"column\", '{kind}' AS kind, count(*) FILTER (WHERE {c} IS NULL) AS nulls, "
                     f"count(DISTINCT {c}) AS d FROM {src}")
    body = "\nUNION ALL ".join(parts)
    num, dt = "kind = 'numeric'", "kind = 'datetime'"
    rows = [
        ("scaling", num, f"CASE WHEN NOT {num} THEN 'Cannot scale non-numeric columns' WHEN nulls > 0 THEN "
         "'Numeric column (' || nulls || ' nulls) - good for scaling' ELSE 'Numeric column - good for scaling' END",
         "'standard'"),
        ("encoding", f"NOT {num} AND NOT {dt}", f"CASE WHEN {num} THEN 'Already numeric - no encoding needed' "
         f"WHEN {dt} THEN 'Use DateTime Decomposition instead' WHEN nulls > 0 THEN 'Categorical/Text column (' || "
         "nulls || ' nulls) - good for encoding' ELSE 'Categorical/Text column - good for encoding' END",
         "CASE WHEN d <= 100 THEN 'one-hot' ELSE 'label' END"),
        ("binning", num, f"CASE WHEN NOT {num} THEN 'Cannot bin non-numeric columns' ELSE "
         "'Numeric column - good for binning' END", "'equal-width'"),
        ("polynomial", num, f"CASE WHEN NOT {num} THEN 'Cannot create polynomial features from non-numeric columns' "
         "ELSE 'Numeric column - good for polynomial expansion' END", "NULL"),
        ("datetime_decomposition", dt, f"CASE WHEN NOT {dt} THEN 'Only datetime columns can be decomposed' ELSE "
         "'DateTime column - good for decomposition' END", "NULL"),
        ("feature_selection", num, f"CASE WHEN NOT {num} THEN 'Feature selection works best on numeric features' "
         "ELSE 'Numeric feature - good for selection' END", "NULL"),
    ]
    sel = "\nUNION ALL ".join(f"SELECT \"column\", '{st}' AS step, {v} AS is_valid, {why} AS reason, "
                              f"CAST({sug} AS VARCHAR) AS suggestion FROM p" for st, v, why, sug in rows)
    return f"p AS ({body})\n{sel}"


@query("column_eligibility", W + ",\n" + _eligibility_sql("clean_events", "clean_events").replace("p AS (", "p AS (", 1))
def q_column_eligibility(spark, sf):
    return R.column_eligibility(_source(spark, sf, "clean_events"))


@query("column_eligibility_orders", "WITH " + _eligibility_sql("orders", "orders"))
def q_column_eligibility_orders(spark, sf):
    return R.column_eligibility(table(spark, sf, "orders"))


FIRST_TEN = """SELECT '{c}' AS "column", list(v ORDER BY first)[:10] AS samples
FROM (SELECT {c}::VARCHAR AS v, min(c_custkey) AS first FROM customer WHERE {c} IS NOT NULL GROUP BY 1) GROUP BY 1"""


@query("dataset_analysis", "WITH s AS (" + "\nUNION ALL ".join(FIRST_TEN.format(c=c) for c in ("c_name", "c_nationkey", "c_mktsegment")) + """),
n AS (SELECT count(*) AS total_rows FROM customer)
SELECT 'customer.parquet' AS filename, "column", array_to_string(samples, '|') AS samples, total_rows, 4::BIGINT AS total_columns FROM s, n""")
def q_dataset_analysis(spark, sf):
    """The analysis bundle; insights, suggestions, order and notes have queries of their own."""
    a = R.analyze_dataset(table(spark, sf, "customer").drop("c_acctbal"), "customer.parquet", row_key="c_custkey")
    rows = [(a["filename"], c["name"], "|".join(map(str, c["sample_values"])), a["total_rows"], a["total_columns"])
            for c in a["column_insights"] if c["name"] != "c_custkey"]
    return spark.createDataFrame(rows, "filename string, column string, samples string, total_rows long, total_columns long")


@query("training_advice", "WITH m AS (" + _models_sql("labels", "quality", 2, True) + """)
SELECT m.*, 'classification' AS problem_type, (SELECT count(quality) FROM labels) AS n_samples, 2::BIGINT AS n_features,
  (SELECT string_agg(quality || ':' || n, ',' ORDER BY n DESC, quality) FROM (SELECT quality, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY 1)) AS classes
FROM m""")
def q_training_advice(spark, sf):
    """Target analysis with its classes, problem type and model list in one."""
    t = R.training_recommendations(table(spark, sf, "labels"), "quality")
    found = sorted(t["target_analysis"]["class_distribution"].items(), key=lambda kv: (-kv[1], kv[0]))
    classes = ",".join(f"{v}:{n}" for v, n in found)
    rows = [("quality", m["rank"], m["model_id"], m["model_name"], m["reason"], m["recommended"], m["priority"], t["problem_type"],
             t["n_samples"], t["n_features"], classes) for m in t["recommended_models"]]
    return spark.createDataFrame(rows, "target string, rank int, model_id string, model_name string, reason string, recommended boolean, "
                                       "priority string, problem_type string, n_samples long, n_features long, classes string")
