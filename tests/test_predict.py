"""Train, save, load and score new rows by replaying the fitted steps."""

import os

from pyspark.sql import functions as F

from sparkprep.fixtures import table
from sparkprep.ml.predict import load_model, predict
from sparkprep.ml.train import run_training, save_training

SMALL = "/root/testdata/sf0.001"


def test_multiclass_predict_roundtrip(spark, scratch):
    orders = table(spark, SMALL, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    res = run_training(orders, "o_orderstatus", "o_orderkey", ["logistic_regression"])
    assert res.problem_type == "classification" and res.results[0]["status"] == "completed"
    saved = load_model(spark, save_training(res, os.path.join(scratch, "models")))
    out = predict(saved, orders.drop("o_orderstatus"))
    classes = set(saved.doc["classes"])
    rows = out.collect()
    assert len(rows) == orders.count()
    assert all(r["predicted_class"] in classes and 0 <= r["confidence"] <= 1 for r in rows)
    assert set(rows[0]["probabilities"]) == classes
    unseen = orders.drop("o_orderstatus").withColumn("o_orderpriority", F.lit("9-NEVER-SEEN"))
    assert predict(saved, unseen).where(F.col("predicted_class").isNull()).count() == 0


def test_regression_predict_and_missing_columns(spark, scratch):
    li = table(spark, SMALL, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("k"), "l_quantity", "l_discount", "l_extendedprice")
    res = run_training(li, "l_extendedprice", "k", ["linear_regression"])
    assert res.problem_type == "regression"
    saved = load_model(spark, save_training(res, os.path.join(scratch, "models")))
    out = predict(saved, li.drop("l_extendedprice"))
    assert "predicted_value" in out.columns and out.where(F.col("predicted_value").isNull()).count() == 0
    try:
        predict(saved, li.select("k", "l_quantity"))
        raise AssertionError("expected a missing-column error")
    except ValueError as e:
        assert "l_discount" in str(e)
