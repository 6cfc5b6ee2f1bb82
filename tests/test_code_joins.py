"""Joins with small tables of codes: the rows stay where they are, however few the values."""

import pytest
from pyspark.sql import functions as F

from sparkprep.ml.encode import apply_codes, fit_train_codes
from sparkprep.ml.train import with_label
from sparkprep.operators import Encoding


def joins(df):
    return [w for w in ("SortMergeJoin", "ShuffledHashJoin", "hashpartitioning") if w in df._jdf.queryExecution().executedPlan().toString()]


@pytest.fixture()
def rows(spark):
    return spark.range(0, 800, 1, 8).select("id", F.when(F.col("id") % 4 > 0, "a").otherwise("b").alias("c"), (F.col("id") % 2).alias("y"))


def test_codes_and_classes_dont_gather_the_rows(rows):
    coded = apply_codes(rows, fit_train_codes(rows, ["c"]))
    assert not joins(coded) and coded.groupBy("c").count().orderBy("c").collect() == [(0, 600), (1, 200)]
    labelled = with_label(rows, "y", [0, 1])
    assert not joins(labelled) and labelled.where("label = y").count() == 800


@pytest.mark.parametrize("method", ["label", "target"])
def test_fitted_encodings_dont_gather_the_rows(rows, method):
    step = Encoding(["c"], method, target_column="y").fit(rows) if method == "target" else Encoding(["c"], method).fit(rows)
    assert not joins(step.transform(rows))
