"""Softmax boosting against a plain version, and models saved with their feature steps."""

import os

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from sparkprep.fixtures import table
from sparkprep.ml.boosting import SoftmaxBoosting, SoftmaxBoostingModel
from sparkprep.ml.predict import load_model, predict, raw_columns
from sparkprep.ml.train import run_training, save_training
from sparkprep.plans.features import FeatureSpec, run_features

SMALL = "/root/testdata/sf0.001"


def plain_boosting(x, y, rounds, depth, step):
    """Scores after each round, with every threshold between two values tried."""
    k, n = int(y.max()) + 1, len(y)
    f = np.tile(np.log(np.bincount(y) / n), (n, 1))
    losses = []
    for _ in range(rounds):
        p = np.exp(f - f.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        losses.append(-np.log(p[np.arange(n), y]).mean())
        for c in range(k):
            g, h = (y == c) - p[:, c], p[:, c] * (1 - p[:, c])
            stack = [(np.arange(n), 0)]
            while stack:
                rows, level = stack.pop()
                best = (1e-12, None)
                if level < depth:
                    for j in range(x.shape[1]):
                        for t in np.unique(x[rows, j])[:-1]:
                            left = x[rows, j] <= t
                            gl, gr = g[rows[left]].sum(), g[rows[~left]].sum()
                            gain = gl**2 / left.sum() + gr**2 / (~left).sum() - (gl + gr)**2 / len(rows)
                            if gain > best[0] + 1e-9:
                                best = (gain, (rows[left], rows[~left]))
                if best[1]:
                    stack += [(part, level + 1) for part in best[1]]
                else:
                    f[rows, c] += step * (k - 1) / k * g[rows].sum() / h[rows].sum()
    return f, losses


def vectors(spark, x, y):
    rows = [(*map(float, a), float(b)) for a, b in zip(x, y)]
    names = [f"x{i}" for i in range(x.shape[1])]
    df = spark.createDataFrame(rows, [*names, "label"])
    return VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep").transform(df)


def test_boosting_against_a_plain_version(spark, scratch):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 8, size=(300, 3)).astype(float)
    y = np.where(x[:, 0] + x[:, 1] > 9, 2, np.where(x[:, 2] > 4, 1, 0))
    y = np.where(rng.random(300) < 0.1, rng.integers(0, 3, 300), y)
    df = vectors(spark, x, y)
    model = SoftmaxBoosting(maxIter=12, maxDepth=2, stepSize=0.3).fit(df)  # longer than ROUNDS_PER_TABLE
    scores, losses = plain_boosting(x, y, 12, 2, 0.3)
    got = np.array([r[0].toArray() for r in model.transform(df).select("rawPrediction").collect()])
    assert np.allclose(got, scores, atol=1e-6)
    assert np.allclose(model.losses, losses, atol=1e-8) and (np.diff(model.losses) < 0).all()
    assert abs(model.featureImportances.toArray().sum() - 1) < 1e-9
    path = os.path.join(scratch, "boosting")
    model.save(path)
    out = SoftmaxBoostingModel.load(path).transform(df).select("prediction", "probability").collect()
    assert [r.prediction for r in out] == scores.argmax(1).tolist()
    assert all(abs(sum(r.probability) - 1) < 1e-9 for r in out)


def test_boosting_with_missing_values_gaps_and_no_rows(spark):
    x = np.array([[np.nan, 1.0], [1.0, 1.0], [2.0, 1.0], [np.nan, 1.0]] * 5)
    df = vectors(spark, x, np.array([2, 0, 0, 2] * 5))  # no row of class 1, a constant feature
    out = SoftmaxBoosting(maxIter=3, maxDepth=3).fit(df).transform(df).select("label", "prediction", "probability").collect()
    assert all(r.label == r.prediction and r.probability[1] < 1e-9 for r in out)
    with pytest.raises(ValueError, match="needs rows"):
        SoftmaxBoosting().fit(df.limit(0))


def test_three_classes_have_confidence(spark, scratch):
    orders = table(spark, SMALL, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    import sparkprep.ml.train as train
    from sparkprep.ml.registry import classification_models
    registry = classification_models() | {"gradient_boosting": lambda ctx: SoftmaxBoosting(maxIter=4)}
    assert type(classification_models()["gradient_boosting"]({"n_classes": 3})) is SoftmaxBoosting
    keep, train.classification_models = train.classification_models, lambda: registry
    try:
        res = run_training(orders, "o_orderstatus", "o_orderkey", ["gradient_boosting"])
    finally:
        train.classification_models = keep
    assert res.results[0]["status"] == "completed", res.results[0].get("error")
    saved = load_model(spark, save_training(res, os.path.join(scratch, "models")))
    rows = predict(saved, orders.drop("o_orderstatus")).collect()
    assert rows and all(0 < r.confidence <= 1 and abs(sum(r.probabilities.values()) - 1) < 1e-9 for r in rows)


def test_raw_rows_are_scored_by_the_steps_of_the_model(spark, scratch):
    rows = [(i, ["a_b", "a", "b c", None, "x.y"][i % 5], ["u_1", "u"][i % 2], float(i % 17), float(3 * (i % 5) + (i % 2) + i % 17)) for i in range(400)]
    raw = spark.createDataFrame(rows, "k long, `c_1` string, c string, size double, y double")
    spec = FeatureSpec.from_dicts([{"type": "encoding", "columns": ["c_1", "c"], "method": "one-hot"},
                                   {"type": "scaling", "columns": ["size"], "method": "standard"},
                                   {"type": "feature_creation", "columns": ["size"], "method": "polynomial", "degree": 2}])
    feats = run_features(raw, spec, drop_ids=False)
    assert {"c_1_a_b", "c_1_a", "c_u", "c_u_1", "size^2"} <= set(feats.output.columns)
    res = run_training(feats.output, "y", "k", ["ridge"], problem_type="regression")
    saved = load_model(spark, save_training(res, os.path.join(scratch, "models"), steps=feats.steps))
    assert raw_columns(saved.steps) == ["c_1", "c", "size"]
    get = lambda df, **how: {r.k: r.predicted_value for r in predict(saved, df, **how).collect()}
    encoded = get(feats.output.drop("y"))
    assert get(raw.drop("y")) == pytest.approx(encoded) and get(raw.drop("y"), raw=True) == pytest.approx(encoded)
    assert len(set(encoded.values())) > 50
    with pytest.raises(ValueError, match="c_1"):
        predict(saved, raw.drop("y", "c_1"))
    unseen = raw.withColumn("c", F.lit("never seen")).drop("y")
    assert len(get(unseen)) == 400


def test_many_classes(spark):
    from sparkprep.ml.train import prepare
    df = spark.range(24_000).selectExpr("id AS k", "concat('c', id % 12000) AS y", "id * 1.0D AS x")
    coded, feats, _, classes, _, _ = prepare(df, "y", "k", "classification", 0.2, 42)
    assert len(classes) == 12_000 and feats == ["x"]
    assert coded.agg(F.count_distinct("label"), F.max("label")).first() == (12_000, 11_999.0)
