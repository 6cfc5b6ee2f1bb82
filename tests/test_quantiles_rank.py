"""Exact distributed quantiles and global ranking against numpy/pandas."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkprep.functions.quantiles import exact_quantiles
from sparkprep.functions.rank import dense_codes, with_global_index, with_running_total

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def _check(spark, values, buckets=16, accuracy=10_000):
    df = spark.createDataFrame([(float(v),) for v in values], "some_value double")
    got = exact_quantiles(df, ["some_value"], PROBS, buckets=buckets, accuracy=accuracy)["some_value"]
    want = np.quantile(np.asarray(values, dtype=float), PROBS)
    assert np.allclose(got, want, rtol=0, atol=1e-9)


def test_histograms_with_hot_value(spark):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.normal(0, 10, 4000), np.full(2000, 3.25), rng.exponential(5, 1000)])
    _check(spark, vals.tolist(), accuracy=100)
    _check(spark, vals.tolist(), buckets=65_536)


def test_extreme_values(spark):
    _check(spark, [5, 1, 4, 4, 2, 9])
    _check(spark, [1.7e308, -1.7e308, 0.0, 5e-324, 1.0, -1e300, 3.0, 2.0], accuracy=10)
    _check(spark, [5e-324, 0.0, 1e-323, 1.5e-323, 5e-324], accuracy=10)


def test_several_columns_ties_and_nan_in_few_jobs(spark):
    rng = np.random.default_rng(5)
    rows = [(float(rng.normal()), int(rng.integers(0, 9)), float("nan") if i % 5 == 0 else float(i), None if i % 3 else 2.5, f"{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "`a.b` double, n long, with_nan double, mostly_null double, x string")
    numeric = ["a.b", "n", "with_nan", "mostly_null"]
    got = exact_quantiles(df, numeric, PROBS, buckets=64, accuracy=50)
    for i, c in enumerate(numeric):
        vals = [r[i] for r in rows if r[i] is not None and not np.isnan(r[i])]
        assert np.allclose(got[c], np.quantile(np.asarray(vals, dtype=float), PROBS), rtol=0, atol=1e-9)
    sc = spark.sparkContext

    def jobs(columns):
        sc.setJobGroup(f"q{len(columns)}", "")
        exact_quantiles(df, columns, [0.25, 0.75])
        n = len(sc.statusTracker().getJobIdsForGroup(f"q{len(columns)}"))
        sc.setLocalProperty("spark.jobGroup.id", None)
        return n
    assert jobs(numeric) <= jobs(["a.b"]) + 2


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=300))
def test_property(spark, values):
    _check(spark, values)
    _check(spark, values, accuracy=50)


def test_all_null_column(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert exact_quantiles(df, ["x"], [0.5])["x"] == [None]


def test_global_index_and_dense_codes(spark):
    rng = np.random.default_rng(3)
    vals = rng.integers(0, 500, 3000).tolist()
    df = spark.createDataFrame([(int(v), i) for i, v in enumerate(vals)], "v long, id long")
    idx = {r["id"]: r["_idx"] for r in with_global_index(df, ["v", "id"], num_partitions=7).collect()}
    order = sorted(range(len(vals)), key=lambda i: (vals[i], i))
    assert all(idx[i] == pos for pos, i in enumerate(order))
    codes = {r["v"]: r["code"] for r in dense_codes(df, "v", num_partitions=5).collect()}
    assert codes == {v: i for i, v in enumerate(sorted(set(vals)))}


def test_running_total(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(2000)], "k long, w double")
    got = {r["k"]: r["cum"] for r in with_running_total(df, ["k"], "w", "cum", num_partitions=6).collect()}
    acc = 0.0
    for i in range(2000):
        acc += i % 7
        assert got[i] == pytest.approx(acc)


def test_approximate_mode_within_rank_error(spark):
    from sparkprep.functions.quantiles import quantiles
    from sparkprep.operators import Binning, RemoveOutliers
    rng = np.random.default_rng(4)
    vals = rng.normal(size=20_000)
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    approx = quantiles(df, ["x"], [0.1, 0.5, 0.9], exact=False, accuracy=1000)["x"]
    srt = np.sort(vals)
    for p, q in zip([0.1, 0.5, 0.9], approx):
        rank = np.searchsorted(srt, q)
        assert abs(rank - p * len(vals)) <= len(vals) / 1000 + 1
    assert quantiles(df, ["x"], [0.5])["x"] == exact_quantiles(df, ["x"], [0.5])["x"]
    assert RemoveOutliers(["x"], exact=False).fit(df).params["bounds"]["x"]["lower"] is not None
    assert len(Binning(["x"], "quantile", 4, exact=False).fit(df).params["edges"]["x"]) == 5


def test_quantiles_from_sketches_of_parts(spark, scratch):
    from sparkprep.functions import sketches
    rng = np.random.default_rng(8)
    days = [rng.normal(size=n) * 10**k for k, n in enumerate((5000, 1, 30_000, 700))]
    frames = [spark.createDataFrame([(f"d{k}", float(v), 7.0 if i % 3 else float("nan"), None) for i, v in enumerate(day)],
                                    "day string, v double, hot double, none double") for k, day in enumerate(days)]
    for k, part in enumerate(frames):  # a day is sketched when it arrives, and not read again
        sketches.build(part, ["v", "hot", "none"], F.col("day")).write.mode("append").parquet(f"{scratch}/sketches")
    kept = spark.read.parquet(f"{scratch}/sketches")
    assert kept.count() == 12 and {r.column: r.n for r in sketches.merge(kept).collect()}["v"] == 35_701
    whole = frames[0].unionAll(frames[1]).unionAll(frames[2]).unionAll(frames[3])
    values = np.concatenate(days)
    got = exact_quantiles(whole, ["v", "hot", "none"], PROBS, sketches=kept)
    assert np.allclose(got["v"], np.quantile(values, PROBS), rtol=0, atol=0)
    assert got["hot"] == [7.0] * len(PROBS) and got["none"] == [None] * len(PROBS)
    assert exact_quantiles(whole, ["v"], PROBS, sketches=kept, buckets=16) == {"v": got["v"]}
    near = sketches.estimates(kept, [0.5])["v"][3][0]
    assert abs((values < near).mean() - 0.5) < sketches.SKETCH_ERROR

    with pytest.raises(ValueError, match="the table"):
        exact_quantiles(whole.limit(100), ["v"], PROBS, sketches=kept)
    with pytest.raises(ValueError, match="no sketches"):
        exact_quantiles(whole.withColumnRenamed("v", "w"), ["w"], PROBS, sketches=kept)
