"""What a column is imputed by when its table grows."""

import os

from pyspark.sql import functions as F

from sparkprep.operators.smart import smart_imputation
from sparkprep.queries import QUERIES, load_all

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_a_measure_stays_numeric_when_its_values_repeat(spark, scratch):
    load_all()
    events = spark.read.parquet(EVENTS)
    step = events.agg(F.max("event_id")).first()[0] + 1
    copies = events.crossJoin(spark.range(20)).withColumn("event_id", F.col("event_id") + F.col("id") * step).drop("id")
    copies.write.parquet(os.path.join(scratch, "events.parquet"))
    got = QUERIES["smart_impute"](spark, scratch)
    flags = [f"event_type_{v}" for v in ("click", "error", "purchase", "signup", "view", "nan")]
    assert set(got.columns) == {"row_id", "event_id", "value", *flags}
    known = copies.unionByName(copies.where("event_id % 10 = 0")).where("event_id % 7 <> 0")
    mean = known.agg(F.avg("value")).first()[0]
    rows = got.where("event_id % 7 = 0").select("value").distinct().collect()
    assert [r.value for r in rows] == [round(mean, 6)]
    assert got.count() == copies.count() + copies.where("event_id % 10 = 0").count()


def test_without_measures_the_share_of_distinct_values_decides(spark):
    df = spark.createDataFrame([(i, float(i % 2) if i % 5 else None) for i in range(100)], "k int, v double")
    assert smart_imputation(df, exclude=("k",)).columns == ["k", "v_0.0", "v_1.0", "v_nan"]
    assert smart_imputation(df, exclude=("k",), measures=("v",)).where("k % 5 = 0").select("v").distinct().first()[0] == 0.5
