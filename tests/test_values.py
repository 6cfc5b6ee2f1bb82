"""Edge-case value tests (FIXTURES.md part C)."""

import math

import pytest
from pyspark.sql import functions as F

from sparkprep.functions.missing import standardize_missing
from sparkprep.functions.quantiles import exact_quantiles
from sparkprep.functions.stats import bias_corrected_skew
from sparkprep.operators import Binning, Encoding, FeatureCreation, FeatureSelection, FillNulls
from sparkprep.operators.select import correlation_decisions


def col(df, name, order="k"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_missing_tokens(spark):
    rows = [(0, " N/A ", 1.0, [1]), (1, "none", float("nan"), []), (2, "[ ]", float("inf"), [2]),
            (3, "", float("-inf"), None), (4, " x ", 2.0, [3]), (5, "\t null  ", None, [4]),
            (6, "{ }", 3.0, [5]), (7, "NaN", 4.0, [6]), (8, "value", 5.0, [7])]
    df = spark.createDataFrame(rows, "k int, s string, d double, a array<int>")
    out = standardize_missing(df)
    assert col(out, "s") == [None, None, None, None, " x ", None, None, None, "value"]
    assert col(out, "d") == [1.0, None, None, None, 2.0, None, 3.0, 4.0, 5.0]
    assert col(out, "a") == [[1], None, [2], None, [3], [4], [5], [6], [7]]


def test_mode_tie_smallest(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([2, 2, 1, 1, 3, None])], "k int, v int")
    f = FillNulls({"v": {"strategy": "mode"}}).fit(df)
    assert f.params["values"]["v"] == 1
    assert col(f.transform(df), "v")[-1] == 1


def test_quantile_linear(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4]], "x double")
    assert exact_quantiles(df, ["x"], [0.25])["x"] == [1.75]


def test_equal_width_bins(spark):
    vals = [0, 1, 2, 3, 4, 5, 10, None]
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(vals)], "k int, x double")
    out = Binning(["x"], "equal-width", 5).fit(df).transform(df)
    assert col(out, "x_binned") == [0, 0, 0, 1, 1, 2, 4, None]


def test_equal_width_constant(spark):
    df = spark.createDataFrame([(0, 3.0), (1, 3.0)], "k int, x double")
    assert col(Binning(["x"], "equal-width", 5).fit(df).transform(df), "x_binned") == [2, 2]


def test_quantile_bins_duplicate_edges(spark):
    vals = [1, 1, 1, 1, 2, 3, 4, 5]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(vals)], "k int, x double")
    assert col(Binning(["x"], "quantile", 4).fit(df).transform(df), "x_binned") == [0, 0, 0, 0, 1, 1, 2, 2]


def test_quantile_bins_constant(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(3)], "k int, x double")
    assert col(Binning(["x"], "quantile", 4).fit(df).transform(df), "x_binned") == [None, None, None]


def test_onehot_with_null(spark):
    df = spark.createDataFrame([(0, "b"), (1, None), (2, "a")], "k int, c string")
    out = Encoding(["c"], "one-hot").fit(df).transform(df)
    assert out.columns == ["k", "c_a", "c_b"]
    assert col(out, "c_a") == [0, 0, 1] and col(out, "c_b") == [1, 0, 0]


def test_label_with_null(spark):
    df = spark.createDataFrame([(0, "b"), (1, None), (2, "a"), (3, "nan")], "k int, c string")
    out = Encoding(["c"], "label").fit(df).transform(df)
    assert col(out, "c") == [1, 2, 0, 2]  # NULL becomes the text 'nan'


@pytest.mark.parametrize("how,expected", [
    ("sum", [33, 33, 0, 40]), ("mean", [8.25, 8.25, None, 40]), ("min", [1, 1, None, 40]),
    ("max", [20, 20, None, 40]), ("count", [4, 4, 0, 1])])
def test_group_aggregate(spark, how, expected):
    df = spark.createDataFrame([(0, "a", 1, 10), (1, "a", 2, 20), (2, None, 3, 30), (3, "b", None, 40)],
                               "k int, g string, v int, w int")
    step = FeatureCreation(["g", "v", "w"], "aggregations", aggregation_type=how, new_column_name="n")
    got = col(step.fit(df).transform(df), "n")
    assert [None if x is None else float(x) for x in got] == [None if x is None else float(x) for x in expected]


def test_bias_corrected_skew(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 10]], "x double")
    v = df.agg(bias_corrected_skew(F.col("x"))).collect()[0][0]
    assert math.isclose(v, 1.763632614803888, rel_tol=1e-12)


def test_constant_column_correlation(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, 1.0)], "a double, b double")
    d = {r["column"]: r["dropped"] for r in correlation_decisions(df, ["a", "b"], 0.5).collect()}
    assert d == {"b": False}
    f = FeatureSelection(["a", "b"], "correlation_filter", threshold=0.5).fit(df)
    assert f.transform(df).columns == ["a", "b"]


def test_datetime_parse(spark):
    df = spark.createDataFrame([(0, "2024-01-01"), (1, "x")], "k int, t string")
    out = FeatureCreation(["t"], "datetime_decomposition").fit(df).transform(df)
    r = out.orderBy("k").collect()
    assert (r[0]["t_year"], r[0]["t_month"], r[0]["t_day"], r[0]["t_hour"]) == (2024, 1, 1, 0)
    assert all(r[1][f"t_{p}"] is None for p in ("year", "month", "day", "hour", "minute", "second"))


def test_polynomial_nulls(spark):
    df = spark.createDataFrame([(0, 2), (1, None)], "k int, x int")
    out = FeatureCreation(["x"], "polynomial", degree=3).fit(df).transform(df)
    assert out.columns == ["k", "x", "x^2", "x^3"]
    r = out.orderBy("k").collect()
    assert (r[0]["x"], r[0]["x^2"], r[0]["x^3"]) == (2.0, 4.0, 8.0) and r[1]["x^3"] is None


def test_scaling_constant_and_log(spark):
    from sparkprep.operators import Scaling
    df = spark.createDataFrame([(0, 5.0, -1.0), (1, 5.0, None), (2, 5.0, 3.0)], "k int, c double, l double")
    out = Scaling(["c", "l"], "standard", {"l": "log", "missing": "minmax"}).fit(df).transform(df)
    assert col(out, "c") == [0.0, 0.0, 0.0]
    assert col(out, "l") == [0.0, None, math.log1p(3.0)]


def test_variance_threshold_moves_kept_to_end(spark):
    df = spark.createDataFrame([(1.0, 0.0, 5.0, "x"), (2.0, 0.0, 7.0, "y")], "a double, z double, b double, s string")
    f = FeatureSelection([], "variance_threshold", threshold=0.0).fit(df)
    assert f.transform(df).columns == ["s", "a", "b"]


def test_correlation_against_numpy(spark):
    import numpy as np
    from sparkprep.operators import select as S
    rng = np.random.default_rng(11)
    base = rng.normal(size=(300, 3))
    data = np.column_stack([base, base[:, 0] * 2 + rng.normal(scale=0.01, size=300), np.ones(300)])
    data[::10, 1] = np.nan
    cols = ["a", "it's", "c.d", "e", "one"]
    df = spark.createDataFrame([tuple(float(v) for v in r) for r in data], ", ".join(f"`{c}` double" for c in cols))
    got = {(r["col_a"], r["col_b"]): r["abs_corr"] for r in S.correlation_pairs(df, cols, 0.5).collect()}
    for i, a in enumerate(cols):
        for j in range(i + 1, len(cols)):
            both = ~np.isnan(data[:, i]) & ~np.isnan(data[:, j])
            want = None if cols[j] == "one" else abs(np.corrcoef(data[both, i], data[both, j])[0, 1])
            assert got[a, cols[j]] == (want if want is None else pytest.approx(want))
    assert S.variance_table(df, ["it's"], 0.1).collect()[0]["variance"] == pytest.approx(np.nanvar(data[:, 1]))


def test_fill_errors_and_notes(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, 3)], "k int, s string, n int")
    with pytest.raises(TypeError):
        FillNulls({"s": {"strategy": "mean"}}).fit(df)           # mean of text -> error naming the column
    with pytest.raises(TypeError):
        FillNulls({"n": {"strategy": "custom", "value": "abc"}}).fit(df)
    f = FillNulls({"n": {"strategy": "custom"}, "s": {"strategy": "unknown"}, "zz": {"strategy": "mean"}}).fit(df)
    assert f.params["values"] == {"n": None, "s": None}       # no value -> column unchanged, noted
    assert [x.get("note") for x in f.meta["summary"]] == ["no fill value; column unchanged"] * 2
    assert col(f.transform(df), "n") == [None, 3]


def test_drop_columns_and_outlier_skips(spark):
    from sparkprep.operators import DropColumns, RemoveOutliers
    df = spark.createDataFrame([(1, "a", 1.0), (2, "b", 100.0)], "k int, s string, x double")
    f = DropColumns(["s", "nope"]).fit(df)
    assert f.meta["columns"] == ["s"] and f.transform(df).columns == ["k", "x"]
    none = RemoveOutliers(["s"]).fit(df)
    assert none.params["bounds"] == {} and none.transform(df).count() == 2
    z = RemoveOutliers(["x"], "zscore", 3.0).fit(spark.createDataFrame([(1, 5.0), (2, 5.0)], "k int, x double"))
    assert z.params["bounds"]["x"]["lower"] is None            # zero spread keeps every row


def test_encoding_skips_and_unknown_methods(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "k int, s string, x double")
    f = Encoding(["x", "missing", "s"], "one-hot", {"s": "weird"}).fit(df)
    assert f.meta["details"] == {"x": "skipped (non-categorical)", "missing": "skipped (column not found)",
                                 "s": "skipped (unknown method: weird)"}
    t = Encoding(["s"], "target").fit(df)
    assert t.meta["details"]["s"] == "target encoding skipped (no target column)"


def test_dotted_names_and_values(spark):
    from sparkprep.operators import RemoveDuplicates, RemoveNulls, RemoveOutliers, Scaling
    from sparkprep.plans.features import FeatureSpec, run_features
    rows = [(i, f"v{i % 3}.0", float(i), None if i % 4 == 0 else float(i * 2), f"g.{i % 2}") for i in range(40)]
    df = spark.createDataFrame(rows, "`row.id` int, `cat.name` string, `x.val` double, `y val` double, `g.k` string")
    d = RemoveDuplicates(["g.k"], "row.id").fit(df).transform(df)
    assert sorted(r["row.id"] for r in d.collect()) == [0, 1]
    assert RemoveDuplicates(None, "row.id").fit(df).transform(df).count() == 40
    assert RemoveNulls(["y val"]).fit(df).transform(df).count() == 30
    assert RemoveOutliers(["x.val"]).fit(df).transform(df).count() == 40
    spec = FeatureSpec.from_dicts([
        {"type": "encoding", "columns": ["cat.name"], "method": "one-hot"},
        {"type": "scaling", "columns": ["cat.name_v1.0", "x.val"], "method": "minmax"},
        {"type": "binning", "columns": ["y val"], "method": "quantile", "bins": 4},
        {"type": "feature_creation", "columns": ["g.k", "x.val"], "method": "aggregations",
         "aggregation_type": "mean", "new_column_name": "g.mean"},
        {"type": "encoding", "columns": ["g.k"], "method": "target", "target_column": "x.val"}])
    out = run_features(df, spec, drop_ids=False).output
    assert {"cat.name_v0.0", "cat.name_v1.0", "y val_binned", "g.mean", "g.k_target_encoded"} <= set(out.columns)
    r = out.orderBy(F.col("`row.id`")).collect()
    assert r[1]["cat.name_v1.0"] == 1.0 and abs(r[1]["g.mean"] - 20 / 39) < 1e-12  # mean of scaled x


def test_nan_is_missing_without_standardisation(spark):
    from sparkprep.operators import RemoveNulls, RemoveOutliers
    df = spark.createDataFrame([(0, 1.0), (1, float("nan")), (2, None), (3, 2.0), (4, 1000.0)], "k int, x double")
    assert col(RemoveNulls(["x"]).fit(df).transform(df), "k") == [0, 3, 4]
    f = FillNulls({"x": {"strategy": "custom", "value": "7"}}).fit(df)
    assert col(f.transform(df), "x") == [1.0, 7.0, 7.0, 2.0, 1000.0]
    vals = [1.0, 2.0, 3.0, 4.0, 5.0, 1000.0, float("nan"), None]
    o = spark.createDataFrame(list(enumerate(vals)), "k int, x double")
    kept = col(RemoveOutliers(["x"], "iqr").fit(o.where("k < 6")).transform(o), "k")
    assert kept == [0, 1, 2, 3, 4, 6, 7]   # NaN/NULL kept as missing, 1000 removed


def test_hot_key_results_match_brute_force(spark):
    import numpy as np
    import pandas as pd
    from sparkprep.operators import RemoveDuplicates
    rng = np.random.default_rng(21)
    n = 30_000
    keys = np.where(np.arange(n) < n // 3, "hot", np.char.add("k", (rng.integers(0, 2000, n)).astype(str)))
    pdf = pd.DataFrame({"rid": np.arange(n), "g": keys, "v": rng.normal(size=n).round(6)})
    df = spark.createDataFrame(pdf).repartition(8)
    first = RemoveDuplicates(["g"], "rid").fit(df).transform(df).toPandas().sort_values("g")
    want = pdf.sort_values("rid").drop_duplicates("g").sort_values("g")
    assert first["rid"].tolist() == want["rid"].tolist()
    agg = FeatureCreation(["g", "v"], "aggregations", aggregation_type="mean", new_column_name="m").fit(df)
    got = agg.transform(df).toPandas().set_index("rid")["m"].sort_index()
    exp = pdf.groupby("g")["v"].transform("mean")
    assert np.allclose(got.values, exp.values)
    te = Encoding(["g"], "target", target_column="v").fit(df).transform(df).toPandas().set_index("rid").sort_index()
    assert np.allclose(te["g_target_encoded"].values, exp.values)
