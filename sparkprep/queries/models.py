"""Model queries (M1-M28): exact oracles for splits, codes and metrics;
rows-only checks for seed/solver-dependent training and prediction."""

from __future__ import annotations

import uuid

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from ..fixtures import table
from ..ml.boosting import SoftmaxBoosting
from ..ml.encode import apply_codes, fit_train_codes
from ..ml.metrics import classification_metrics, confusion_table, regression_metrics, residuals, roc_auc
from ..ml.predict import extra_columns, load_model, looks_raw, missing_features, predict
from ..ml.registry import regression_models
from ..ml.split import hash_split, prepare_split, stratified_split
from ..ml.train import run_training, save_training, with_label
from ..operators import Encoding
from ..plans.features import FeatureSpec, run_features
from ..session import ensure_checkpoint_dir
from ..sources.registry import list_models
from . import query, r6

MD5_BUCKET = "(('0x' || substr(md5(CAST({k} AS VARCHAR) || '42'), 1, 8))::BIGINT % 10000)"
MD5_HASH = "('0x' || substr(md5(CAST({k} AS VARCHAR) || '42'), 1, 15))::BIGINT"


def _labeled_docs(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source")
    return docs.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


@query("hash_split", f"SELECT doc_id, {MD5_BUCKET.format(k='doc_id')} < 2000 AS is_test FROM documents")
def q_hash_split(spark, sf):
    return hash_split(table(spark, sf, "documents").select("doc_id"), "doc_id", 0.2)


@query("stratified_split", f"""
SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {MD5_HASH.format(k='doc_id')}, doc_id) - 1
  < CAST(floor(0.2 * count(*) OVER (PARTITION BY quality) + 0.5) AS BIGINT) AS is_test FROM labels""")
def q_stratified_split(spark, sf):
    return stratified_split(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "quality", 0.2)


@query("stratified_split_many", f"""
WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS k, CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_partkey % 400 END AS y FROM lineitem)
SELECT k, y, row_number() OVER (PARTITION BY y ORDER BY {MD5_HASH.format(k='k')}, k) - 1
  < CAST(floor(0.2 * count(*) OVER (PARTITION BY y) + 0.5) AS BIGINT) AS is_test FROM l""")
def q_stratified_split_many(spark, sf):
    """Hundreds of classes, NULL among them."""
    l = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber AS k", "CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_partkey % 400 END AS y")
    return stratified_split(l, "k", "y", 0.2)


@query("train_only_encode", f"""
WITH s AS (SELECT doc_id, lang, source, {MD5_BUCKET.format(k='doc_id')} < 2000 AS is_test FROM documents),
l AS (SELECT lang AS v, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS BIGINT) AS code
      FROM (SELECT DISTINCT coalesce(lang, 'missing') AS lang FROM s WHERE NOT is_test)),
r AS (SELECT source AS v, CAST(dense_rank() OVER (ORDER BY source) - 1 AS BIGINT) AS code
      FROM (SELECT DISTINCT coalesce(source, 'missing') AS source FROM s WHERE NOT is_test))
SELECT s.doc_id, s.is_test, coalesce(l.code, -1) AS lang, coalesce(r.code, -1) AS source
FROM s LEFT JOIN l ON coalesce(s.lang, 'missing') = l.v LEFT JOIN r ON coalesce(s.source, 'missing') = r.v""")
def q_train_only_encode(spark, sf):
    s = hash_split(table(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id", 0.2)
    d = fit_train_codes(s.where(~F.col("is_test")), ["lang", "source"])
    return apply_codes(s, d)


@query("linreg_one_feature", """
SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
       round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem""")
def q_linreg_one_feature(spark, sf):
    li = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice")
    vec = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(li)
    m = LinearRegression(featuresCol="features", labelCol="l_extendedprice", regParam=0.0, solver="normal").fit(vec)
    return spark.range(1).select(F.round(F.lit(float(m.coefficients[0])), 4).alias("slope"),
                                 F.round(F.lit(float(m.intercept)), 4).alias("intercept"))


def _one_feature(spark, sf, name):
    """Slope and intercept of a registered model over one feature of the whole table."""
    li = table(spark, sf, "lineitem").select("l_quantity", F.col("l_extendedprice").alias("label"))
    vec = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(li)
    s = li.agg(F.count("*").alias("n"), F.stddev_pop("label").alias("sd")).first()
    m = regression_models()[name]({"n_train": s["n"], "sigma_y": s["sd"]}).fit(vec)
    return spark.range(1).select(F.round(F.lit(float(m.coefficients[0])), 4).alias("slope"),
                                 F.round(F.lit(float(m.intercept)), 4).alias("intercept"))


MOMENTS_SQL = """
WITH m AS (SELECT count(*) AS n, avg(l_quantity) AS mx, avg(l_extendedprice) AS my, var_pop(l_quantity) AS vx,
                  covar_pop(l_extendedprice, l_quantity) AS cxy FROM lineitem)"""


@query("ridge_one_feature", MOMENTS_SQL + """,
s AS (SELECT *, n * cxy / (n * vx + 1) AS slope FROM m)
SELECT round(slope, 4) AS slope, round(my - slope * mx, 4) AS intercept FROM s""")
def q_ridge_one_feature(spark, sf):
    return _one_feature(spark, sf, "ridge")


@query("lasso_one_feature", MOMENTS_SQL + """,
s AS (SELECT *, sign(cxy) * greatest(abs(cxy) - 1, 0) / vx AS slope FROM m)
SELECT round(slope, 4) AS slope, round(my - slope * mx, 4) AS intercept FROM s""")
def q_lasso_one_feature(spark, sf):
    return _one_feature(spark, sf, "lasso")


CONF_SQL = """
WITH lab AS (SELECT quality AS v FROM labels UNION SELECT toxic FROM labels),
g AS (SELECT a.v AS actual, p.v AS predicted FROM lab a, lab p),
c AS (SELECT quality AS actual, toxic AS predicted, count(*) AS n FROM labels GROUP BY ALL),
m AS (SELECT g.actual, g.predicted, CAST(coalesce(c.n, 0) AS BIGINT) AS count FROM g LEFT JOIN c USING (actual, predicted))"""


@query("confusion_matrix", CONF_SQL + "\nSELECT * FROM m")
def q_confusion_matrix(spark, sf):
    return confusion_table(table(spark, sf, "labels"), "quality", "toxic")


@query("weighted_prf", CONF_SQL + """,
per AS (SELECT actual AS c, sum(count) AS support, sum(count) FILTER (WHERE actual = predicted) AS tp FROM m GROUP BY 1),
pp AS (SELECT predicted AS c, sum(count) AS pn FROM m GROUP BY 1),
x AS (SELECT coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, coalesce(pn, 0) AS pn FROM per FULL JOIN pp USING (c)),
y AS (SELECT support, tp, CASE WHEN pn > 0 THEN tp / pn ELSE 0 END AS p,
             CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r FROM x)
SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(sum(p * support) / sum(support), 6) AS precision,
       round(sum(r * support) / sum(support), 6) AS recall,
       round(sum(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END * support) / sum(support), 6) AS f1_score FROM y""")
def q_weighted_prf(spark, sf):
    m = classification_metrics(confusion_table(table(spark, sf, "labels"), "quality", "toxic"))
    return m.select(*[r6(F.col(c)).alias(c) for c in m.columns])


@query("auc_exact", """
WITH d AS (SELECT l.quality AS y, CAST(d.n_chars AS DOUBLE) AS s FROM documents d JOIN labels l USING (doc_id)),
r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM d)
SELECT round((sum(rk) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0)
  / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y <> 1)), 6) AS roc_auc FROM r""")
def q_auc_exact(spark, sf):
    d = _labeled_docs(spark, sf)
    return roc_auc(d, "quality", "n_chars", 1).select(r6(F.col("roc_auc")).alias("roc_auc"))


REG_PRED = "(l.l_quantity * p.p_retailprice)"


def _reg_frame(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    return li.join(part, "l_partkey").withColumn("yhat", F.col("l_quantity") * F.col("p_retailprice"))


@query("regression_metrics", f"""
WITH j AS (SELECT l.l_extendedprice AS y, {REG_PRED} AS yhat FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
s AS (SELECT count(*) AS n, avg(abs(y - yhat)) AS mae, avg((y - yhat) * (y - yhat)) AS mse, var_pop(y) AS vy FROM j)
SELECT round(mae, 4) AS mae, round(mse, 4) AS mse, round(sqrt(mse), 4) AS rmse, round(1 - mse / vy, 6) AS r2_score,
       round(CASE WHEN n > 2 THEN 1 - (mse / vy) * (n - 1) / (n - 2) ELSE 1 - mse / vy END, 6) AS adjusted_r2 FROM s""")
def q_regression_metrics(spark, sf):
    m = regression_metrics(_reg_frame(spark, sf), "l_extendedprice", "yhat", p=1)
    return m.select(*[F.round(F.col(c), 4).alias(c) for c in ("mae", "mse", "rmse")],
                    r6(F.col("r2_score")).alias("r2_score"), r6(F.col("adjusted_r2")).alias("adjusted_r2"))


@query("residuals", f"""
SELECT l.l_orderkey, l.l_linenumber, round(l.l_extendedprice - {REG_PRED}, 6) AS residual
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey ORDER BY l.l_orderkey, l.l_linenumber LIMIT 1000""")
def q_residuals(spark, sf):
    r = residuals(_reg_frame(spark, sf), ["l_orderkey", "l_linenumber"], "l_extendedprice", "yhat", 1000)
    return r.withColumn("residual", r6(F.col("residual")))


def _results(spark, res):
    """Scores of all models; a model that failed fails the query."""
    failed = [f"{r['model']}: {r.get('error')}" for r in res.results if r["status"] != "completed" or r.get("score") is None]
    if failed:
        raise RuntimeError("; ".join(failed))
    return res.results_frame(spark).select("model", "status", r6(F.col("score")).alias("score"))


@query("train_automl")
def q_train_automl(spark, sf):
    res = run_training(_labeled_docs(spark, sf), "quality", "doc_id")
    return _results(spark, res).withColumn("is_best", F.col("model") == F.lit(res.best_model))


@query("train_regression")
def q_train_regression(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("row_key"), "l_quantity", "l_discount", "l_tax",
        "l_returnflag", "l_extendedprice")
    res = run_training(li, "l_extendedprice", "row_key", ["linear_regression", "ridge", "lasso"])
    return _results(spark, res)


@query("feature_importance")
def q_feature_importance(spark, sf):
    res = run_training(_labeled_docs(spark, sf), "quality", "doc_id", ["random_forest"])
    rows = res.results[0].get("feature_importance", [])
    return spark.createDataFrame(rows, "feature string, importance double")


@query("predict_batch")
def q_predict_batch(spark, sf):
    res = run_training(_labeled_docs(spark, sf), "quality", "doc_id", ["logistic_regression"])
    root = save_training(res, f"{ensure_checkpoint_dir(spark)}/models-{uuid.uuid4().hex[:8]}")
    saved = load_model(spark, root)
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source")
    return predict(saved, docs).select("doc_id", "predicted_class", F.round("confidence", 4).alias("confidence"))


@query("predict_raw_equals_encoded", f"""
WITH d AS (SELECT doc_id, lang, n_chars, {MD5_BUCKET.format(k='doc_id')} < 2000 AS is_test FROM documents),
m AS (SELECT lang, avg(n_chars) AS v FROM d WHERE NOT is_test GROUP BY lang)
SELECT doc_id, round(v, 2) AS from_raw, round(v, 2) AS from_encoded FROM d JOIN m USING (lang)""")
def q_predict_raw_equals_encoded(spark, sf):
    """A model on indicators predicts the mean of each category, from rows of either form."""
    docs = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("in_"), "lang", F.lit("_x")).alias("spoken_in"), "n_chars")
    feats = run_features(docs, FeatureSpec.from_dicts([{"type": "encoding", "columns": ["spoken_in"], "method": "one-hot"}]), drop_ids=False)
    res = run_training(feats.output, "n_chars", "doc_id", ["linear_regression"], problem_type="regression")
    root = save_training(res, f"{ensure_checkpoint_dir(spark)}/models-{uuid.uuid4().hex[:8]}", steps=feats.steps)
    saved = load_model(spark, root)
    value = lambda name: F.round("predicted_value", 2).alias(name)
    raw = predict(saved, docs.drop("n_chars")).select("doc_id", value("from_raw"))
    return raw.join(predict(saved, feats.output.drop("n_chars")).select("doc_id", value("from_encoded")), "doc_id")


@query("boosting_one_split", """
WITH d AS (SELECT lang, CASE WHEN n_chars > 2000 THEN 1.0 ELSE 0.0 END AS is_long FROM documents),
c AS (SELECT lang, count(*)::DOUBLE / sum(count(*)) OVER () AS p, count(*) OVER () AS k FROM d GROUP BY lang),
n AS (SELECT is_long, count(*)::DOUBLE AS n FROM d GROUP BY is_long),
m AS (SELECT is_long, lang, count(*) AS m FROM d GROUP BY is_long, lang),
s AS (SELECT is_long, lang, ln(p) + 0.1 * (k - 1) / k * (coalesce(m, 0) - n * p) / (n * p * (1 - p)) AS f
      FROM n CROSS JOIN c LEFT JOIN m USING (is_long, lang))
SELECT is_long::DOUBLE AS is_long, lang, round(exp(f) / sum(exp(f)) OVER (PARTITION BY is_long), 6) AS probability FROM s""")
def q_boosting_one_split(spark, sf):
    """M9: one round of one split over several classes; each leaf takes the Newton step of its class."""
    docs = table(spark, sf, "documents").select("lang", (F.col("n_chars") > 2000).cast("double").alias("is_long"))
    classes = sorted(r[0] for r in docs.select("lang").distinct().collect())
    vec = VectorAssembler(inputCols=["is_long"], outputCol="features").transform(with_label(docs, "lang", classes))
    model = SoftmaxBoosting(maxIter=1, maxDepth=1, stepSize=0.1).fit(vec)
    each = model.transform(vec.select("is_long", "features").dropDuplicates(["is_long"]))
    return each.select("is_long", F.posexplode(vector_to_array("probability")).alias("i", "p")).select(
        "is_long", F.element_at(F.array(*[F.lit(c) for c in classes]), F.col("i") + 1).alias("lang"), r6(F.col("p")).alias("probability"))


@query("model_registry")
def q_model_registry(spark, sf):
    base = f"{ensure_checkpoint_dir(spark)}/registry-{uuid.uuid4().hex[:8]}"
    res = run_training(_labeled_docs(spark, sf), "quality", "doc_id", ["logistic_regression"])
    save_training(res, base)
    return list_models(spark, base).select("problem_type", "target_column", "best_model")


@query("holdout_linear_metrics", f"""
WITH s AS (SELECT l_extendedprice AS y, l_quantity AS x,
                  {MD5_BUCKET.format(k="concat_ws('-', l_orderkey, l_linenumber)")} < 2000 AS is_test FROM lineitem),
c AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM s WHERE NOT is_test),
t AS (SELECT y, a + b * x AS yhat FROM s, c WHERE is_test)
SELECT round(avg(abs(y - yhat)), 2) AS mae, round(sqrt(avg((y - yhat) * (y - yhat))), 2) AS rmse,
       round(1 - avg((y - yhat) * (y - yhat)) / var_pop(y), 6) AS r2_score FROM t""")
def q_holdout_linear_metrics(spark, sf):
    """M1, M2, M10, M14, M18 end to end: split -> fit -> evaluate, with one feature."""
    li = table(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("row_key"),
                                             "l_quantity", "l_extendedprice")
    res = run_training(li, "l_extendedprice", "row_key", ["linear_regression"], problem_type="regression")
    m = res.results[0]["metrics"]
    return spark.createDataFrame([(round(m["mae"], 2), round(m["rmse"], 2), round(m["r2_score"], 6))],
                                 "mae double, rmse double, r2_score double")


def _warned(source: str, target: str) -> str:
    """Rows, test rows of the split by class, and the warnings they bring."""
    return f"""SELECT '{source}' AS source, n, t,
  CASE WHEN n < 100 THEN 'Very small dataset (' || n || ' samples). Results may not be reliable.' END AS w1,
  CASE WHEN t < 20 THEN 'Very small test set (' || t || ' samples). Consider using cross-validation.' END AS w2
FROM (SELECT sum(c)::BIGINT AS n, sum(floor(0.2 * c + 0.5))::BIGINT AS t FROM (SELECT {target}, count(*) AS c FROM {source} WHERE {target} IS NOT NULL GROUP BY 1))"""


@query("split_warnings", "WITH w AS (" + _warned("nation", "n_regionkey") + "\nUNION ALL " + _warned("orders", "o_orderpriority") + """)
SELECT source, n AS rows, t AS test_rows, concat_ws(' ', w1, w2) AS warnings FROM w""")
def q_split_warnings(spark, sf):
    """M4: what a split warns of."""
    rows = []
    for source, key, target in (("nation", "n_nationkey", "n_regionkey"), ("orders", "o_orderkey", "o_orderpriority")):
        _, warnings, counts = prepare_split(table(spark, sf, source), target, key)
        rows.append((source, counts["rows"], counts["test_rows"], " ".join(warnings)))
    return spark.createDataFrame(rows, "source string, rows long, test_rows long, warnings string")


@query("leakage_warning", f"""
WITH s AS (SELECT l_extendedprice AS y, l_extendedprice * 2 AS x, {MD5_BUCKET.format(k="concat_ws('-', l_orderkey, l_linenumber)")} < 2000 AS is_test FROM lineitem),
c AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM s WHERE NOT is_test),
r AS (SELECT 1 - avg((y - a - b * x) * (y - a - b * x)) / var_pop(y) AS r2 FROM s, c WHERE is_test)
SELECT 'linear_regression' AS best_model, round(r2, 4) AS score, r2 >= 0.99 AS warned FROM r""")
def q_leakage_warning(spark, sf):
    """A feature that gives the target away is warned of."""
    li = table(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("row_key"),
                                             (F.col("l_extendedprice") * 2).alias("twice"), "l_extendedprice")
    res = run_training(li, "l_extendedprice", "row_key", ["linear_regression"], problem_type="regression")
    warned = any(w.startswith("Suspiciously high score") for w in res.warnings)
    return spark.createDataFrame([(res.best_model, round(res.results[0]["score"], 4), warned)], "best_model string, score double, warned boolean")


@query("raw_detection", """
WITH n AS (SELECT count(*) AS rows, count(lang) AS spoken FROM documents),
v AS (SELECT string_agg('in_' || lang, ',' ORDER BY lang) AS made FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL))
SELECT 'raw' AS form, true AS looks_raw, (SELECT made FROM v) AS missing, 'lang' AS extra, rows, spoken FROM n
UNION ALL SELECT 'encoded', false, '', '', rows, NULL FROM n""")
def q_raw_detection(spark, sf):
    """Raw rows are told from encoded ones by the columns that the model's features were made from."""
    docs = table(spark, sf, "documents").select(F.col("lang").alias("in"), "n_chars")
    step = Encoding(["in"], "one-hot").fit(docs)
    features = [*step.makes(), "n_chars"]
    rows = []
    for form, df in (("raw", docs), ("encoded", step.transform(docs))):
        named = ["lang" if c == "in" else c for c in extra_columns(df, features)]
        counts = df.agg(F.count("*"), F.count("in") if "in" in df.columns else F.lit(None).cast("long")).first()
        rows.append((form, looks_raw(df, features), ",".join(sorted(missing_features(df, features))), ",".join(named), *counts))
    return spark.createDataFrame(rows, "form string, looks_raw boolean, missing string, extra string, rows long, spoken long")
