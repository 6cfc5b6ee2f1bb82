"""Registry parameters reproduce the reference library's objectives
(ridge alpha=1 closed form; logistic regression C=1 Newton solution)."""

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from sparkprep.ml.registry import classification_models, regression_models
from sparkprep.ml.split import hash_split, split_bucket


def _frame(spark, X, y):
    rows = [tuple(float(v) for v in x) + (float(t),) for x, t in zip(X, y)]
    df = spark.createDataFrame(rows, "a double, b double, c double, label double")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(200, 3))
    y = X @ np.array([1.5, -2.0, 0.5]) + 3 + rng.normal(scale=0.3, size=200)
    est = regression_models()["ridge"]({"n_train": 200, "sigma_y": float(np.std(y))})
    m = est.fit(_frame(spark, X, y))
    Xc, yc = X - X.mean(0), y - y.mean()
    w = np.linalg.solve(Xc.T @ Xc + 1.0 * np.eye(3), Xc.T @ yc)
    assert np.allclose(m.coefficients.toArray(), w, atol=1e-5)
    assert abs(m.intercept - (y.mean() - X.mean(0) @ w)) < 1e-5


def test_logistic_matches_newton(spark):
    rng = np.random.default_rng(9)
    X = rng.normal(size=(200, 3))
    p = 1 / (1 + np.exp(-(X @ np.array([1.0, -1.0, 0.5]) + 0.2)))
    y = (rng.uniform(size=200) < p).astype(float)
    est = classification_models()["logistic_regression"]({"n_train": 200, "n_classes": 2})
    m = est.fit(_frame(spark, X, y))
    # minimise 0.5*||w||^2 + sum(logloss) (C = 1, intercept not penalised)
    Z = np.column_stack([X, np.ones(200)])
    beta = np.zeros(4)
    for _ in range(50):
        mu = 1 / (1 + np.exp(-Z @ beta))
        g = Z.T @ (mu - y) + np.r_[beta[:3], 0]
        H = Z.T @ (Z * (mu * (1 - mu))[:, None]) + np.diag([1, 1, 1, 0])
        beta -= np.linalg.solve(H, g)
    assert np.allclose(m.coefficients.toArray(), beta[:3], atol=1e-4)
    assert abs(m.intercept - beta[3]) < 1e-4


def test_hash_split_is_deterministic_and_sized(spark):
    df = spark.range(20000).withColumnRenamed("id", "k")
    a = hash_split(df, "k", 0.2).where("is_test").count()
    b = hash_split(df, "k", 0.2).where("is_test").count()
    assert a == b and abs(a / 20000 - 0.2) < 0.02
    assert df.select(split_bucket(F.col("k")).alias("b")).agg(F.max("b")).collect()[0][0] < 10000


def test_stratified_split_against_brute_force(spark):
    from pyspark.sql import Window
    from sparkprep.ml import split as S
    df = spark.range(120_000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("y"))
    w = Window.partitionBy("y").orderBy(S.split_hash(F.col("k")), F.col("k"))
    cnt = Window.partitionBy("y")
    brute = df.select("k", ((F.row_number().over(w) - 1) <
                            F.floor(F.count(F.lit(1)).over(cnt) * 0.2 + 0.5)).alias("want"))
    got = S.stratified_split(df, "k", "y", 0.2)
    bad = got.join(brute, "k").where(F.col("is_test") != F.col("want")).count()
    assert bad == 0
    many = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 40).alias("y"))
    got2 = S.stratified_split(many, "k", "y", 0.2)
    assert got2.where("is_test").count() == sum(int(0.2 * 75 + 0.5) for _ in range(40))
