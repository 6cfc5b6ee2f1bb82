"""Fitted-step save/load and replay, bundles, schema helpers, I/O errors, streaming replay."""

import os

import pytest
from pyspark.sql import functions as F

from sparkprep.fixtures import table
from sparkprep.ml.predict import align_to_schema, looks_raw, missing_features
from sparkprep.operators.diff import column_summary
from sparkprep.operators.recommend import analyze_dataset, cleaning_suggestions, training_recommendations
from sparkprep.operators.views import schema_check
from sparkprep.plans.base import load_steps, save_steps
from sparkprep.plans.features import FeatureSpec, replay, run_features
from sparkprep.sources.readers import detect_format, load_table
from sparkprep.streaming import replay_stream, start_scoring

SPEC = [{"type": "encoding", "columns": ["c_mktsegment", "c_name"], "method": "one-hot"},
        {"type": "scaling", "columns": ["c_acctbal"], "method": "robust"},
        {"type": "binning", "columns": ["c_acctbal"], "method": "equal-width", "bins": 4}]


def _rows(df, key):
    return sorted(tuple(r) for r in df.orderBy(key).collect())


def test_fit_save_load_replay(spark, sf_dir, scratch):
    df = table(spark, sf_dir, "customer")
    res = run_features(df, FeatureSpec.from_dicts(SPEC))
    assert "c_name" in res.output.columns  # auto-switched to label encoding (> 100 values)
    path = os.path.join(scratch, "steps")
    save_steps(res.steps, path)
    steps = load_steps(spark, path)
    new = df.where(F.col("c_custkey") % 3 == 0)
    assert _rows(replay(new, steps), "c_custkey") == _rows(replay(new, res.steps), "c_custkey")
    assert res.columns["removed_columns"] == ["c_mktsegment"]


def test_upto_step(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    res = run_features(df, FeatureSpec.from_dicts(SPEC), upto_step=0)
    assert "c_acctbal_binned" not in res.output.columns and len(res.steps) == 1


def test_bundles(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    sampled = analyze_dataset(df, row_key=df.columns[0])["column_insights"]
    assert all(1 <= len(c["sample_values"]) <= 10 for c in sampled if c["name"] != df.columns[0])
    a = analyze_dataset(df, "orders.parquet")
    assert a["suggested_pipeline"][0] == "encoding" and a["total_columns"] == 6
    t = training_recommendations(table(spark, sf_dir, "labels").drop("toxic"), "quality")
    assert t["problem_type"] == "classification" and t["recommended_models"][0]["model_id"] == "logistic_regression"
    s = cleaning_suggestions(df)
    assert s["removeDuplicates"]["enabled"] is False


def test_schema_helpers(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "x int, c string, extra double")
    assert schema_check(df, ["x", "y"]) == {"missing": ["y"], "extra": ["c", "extra"]}
    assert missing_features(df, ["x", "y"]) == ["y"]
    assert looks_raw(df, ["c_a", "c_b", "x"])
    out = align_to_schema(df, ["x", "c", "y"]).collect()[0]
    assert (out["x"], out["c"], out["y"]) == (1.0, 0.0, 0.0)
    assert column_summary(["a", "b"], ["b", "c"])["added_columns"] == ["c"]


def test_format_dispatch(spark, scratch):
    assert detect_format("x/data.JSONL") == "jsonl"
    with pytest.raises(ValueError):
        detect_format("book.xlsx")
    p = os.path.join(scratch, "t.csv")
    with open(p, "w") as fh:
        fh.write("a,b\n1, N/A \n2,x\n")
    assert [r["b"] for r in load_table(spark, p).orderBy("a").collect()] == [None, "x"]


def test_stream_replay(spark, sf_dir, scratch):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    res = run_features(df, FeatureSpec.from_dicts([SPEC[0] | {"columns": ["c_mktsegment"]}, SPEC[1]]))
    src = os.path.join(scratch, "in")
    df.write.parquet(src)
    q = start_scoring(spark.readStream.schema(df.schema).parquet(src), res.steps,
                      os.path.join(scratch, "out"), os.path.join(scratch, "ckpt"), trigger_once=True)
    q.awaitTermination(120)
    got = spark.read.parquet(os.path.join(scratch, "out"))
    assert got.count() == df.count()
    assert _rows(got.select(*res.output.columns), "c_custkey") == _rows(replay(df, res.steps), "c_custkey")
    with pytest.raises(ValueError):
        from sparkprep.operators import RemoveDuplicates
        replay_stream(spark.readStream.schema(df.schema).parquet(src), [RemoveDuplicates().fit(df)])


def test_cleaning_details_and_preview(spark, sf_dir):
    from sparkprep.fixtures import clean_events
    from sparkprep.operators.profile import dataset_preview
    from sparkprep.plans.cleaning import CleanSpec, run_cleaning
    from sparkprep.queries.cleaning import CLEAN_RUN_SPEC
    res = run_cleaning(clean_events(spark, sf_dir), CleanSpec(**CLEAN_RUN_SPEC))
    d = {x["step_type"]: x for x in res.details()}
    assert d["remove_outliers"]["method"] == "IQR" and "value" in d["remove_outliers"]["bounds"]
    fills = {x["column"]: x for x in d["fill_nulls"]["summary"]}
    assert fills["value"]["strategy"] == "median" and fills["event_type"]["strategy"] == "mode"
    log = {r["operation"]: r["rows_removed"] for r in res.change_log().collect()}
    assert log["drop_columns"] == 0 and log["remove_duplicates"] > 0
    p = dataset_preview(table(spark, sf_dir, "customer"), "c_custkey", 10)
    assert len(p["records"]) == 10 and p["total_rows"] > 10 and len(p["columns"]) == 5


def test_json_safe_types(spark):
    import datetime as dt
    import decimal
    from sparkprep.sources.readers import json_safe
    df = spark.createDataFrame(
        [(bytearray(b"ok"), decimal.Decimal("1.50"), dt.date(2024, 1, 2), {"b": 1, "a": 2}, [1, 2], float("inf"))],
        "b binary, d decimal(5,2), day date, m map<string,int>, a array<int>, f double")
    r = json_safe(df).collect()[0]
    assert (r["b"], r["d"], r["day"], r["a"], r["f"]) == ("ok", 1.5, "2024-01-02", "[1,2]", None)
    assert r["m"] in ('{"b":1,"a":2}', '{"a":2,"b":1}')


def test_diff_maps_arrays_nan(spark):
    from sparkprep.operators.diff import deleted_rows, updated_cells
    a = spark.createDataFrame([(1, {"x": 1, "y": 2}, [1], float("nan")), (2, {"x": 1}, [2], 1.0), (3, None, None, None)],
                              "k int, m map<string,int>, a array<int>, f double")
    b = spark.createDataFrame([(1, {"y": 2, "x": 1}, [1], None), (2, {"x": 2}, [2, 3], 1.0)],
                              "k int, m map<string,int>, a array<int>, f double")
    cells = sorted((r["row_id"], r["column"]) for r in updated_cells(a, b, "k").collect())
    assert cells == [(2, "a"), (2, "m")]   # NaN vs NULL and reordered map keys are equal
    assert [r["k"] for r in deleted_rows(a, b, "k").collect()] == [3]


def test_approx_insights_close(spark, sf_dir):
    from sparkprep.operators.profile import column_insights
    df = table(spark, sf_dir, "customer")
    exact = {r["name"]: r["cardinality"] for r in column_insights(df).collect()}
    approx = {r["name"]: r["cardinality"] for r in column_insights(df, approx=True).collect()}
    assert all(abs(approx[k] - v) <= max(2, 0.1 * v) for k, v in exact.items())


def test_deep_page_matches_offset(spark):
    from sparkprep.operators import views as V
    df = spark.range(300_000).select(F.col("id"), ((F.col("id") * 7919) % 1000).alias("v"))
    order = ["v", "id"]
    deep = V.page(df, order, 150_000 // 50, 50).collect()
    shallow = df.orderBy(*order).offset(150_000).limit(50).collect()
    assert [tuple(r) for r in deep] == [tuple(r) for r in shallow]
    down = [F.col("v").desc(), F.col("id")]
    assert [tuple(r) for r in V.page(df, [V.Key("v", ascending=False), "id"], 2500, 50).collect()] == [tuple(r) for r in df.orderBy(*down).offset(125_000).limit(50).collect()]


def test_leaderboard_helpers(spark):
    from sparkprep.operators import views as V
    models = spark.createDataFrame([
        ("m1", "a.csv", "y", "classification", "logistic_regression", 0.9, "2024-01-02"),
        ("m2", "a.csv", "y", "classification", "random_forest", 0.95, "2024-01-03"),
        ("m3", None, "z", "regression", "lasso", 0.5, "2024-01-01"),
        ("m4", "b.csv", "y", "classification", "svm_rbf", None, None)],
        "model_id string, filename string, target_column string, problem_type string, best_model string, "
        "score double, created_at string")
    lb = V.leaderboard(models, "classification", None, "accuracy").collect()
    assert [r["model_id"] for r in lb] == ["m2", "m1", "m4"]
    assert [r["family"] for r in lb] == ["Ensemble Methods", "Linear Models", "Support Vector"]
    assert [r["model_id"] for r in V.leaderboard(models, sort="date").collect()][:1] == ["m2"]
    g = {(r["file"], r["target"]): r["models"] for r in V.group_models(models).collect()}
    assert g[("a.csv", "y")] == ["m1", "m2"] and g[("Unknown", "z")] == ["m3"]
    t = V.type_counts(models).collect()[0]
    assert (t["total"], t["classification"], t["regression"]) == (4, 3, 1)
    assert [r["model_id"] for r in V.top_k(models, "score", 3, "model_id").collect()] == ["m2", "m1", "m3"]


def test_size_shuffle_partitions(spark, sf_dir):
    from sparkprep.session import input_bytes, size_shuffle_partitions
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        size = input_bytes(spark, f"{sf_dir}/lineitem.parquet")
        assert size > 0
        n = size_shuffle_partitions(spark, [f"{sf_dir}/lineitem.parquet"], target_bytes=64 << 10)
        assert n == max(8, int(size * 3.0 / (64 << 10)) + 1)
        assert spark.conf.get("spark.sql.shuffle.partitions") == str(n)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_with_row_id(spark, sf_dir, scratch):
    from sparkprep.sources.readers import with_row_id
    pq = with_row_id(spark.read.parquet(f"{sf_dir}/region.parquet"))
    rows = pq.orderBy("_orig_idx").collect()
    assert [r["_orig_idx"]["row"] for r in rows] == list(range(len(rows)))   # file order kept
    p = os.path.join(scratch, "r.csv")
    with open(p, "w") as fh:
        fh.write("a\n1\n2\n3\n")
    csv = with_row_id(spark.read.csv(p, header=True))
    ids = [r["_orig_idx"] for r in csv.collect()]
    assert len(set(ids)) == 3


def test_rows_at_ranks_against_sorting(spark):
    import random

    from sparkprep.functions.rank_select import Key, rows_at
    rng = random.Random(6)
    rows = [(i, rng.choice([None, 1.5, 1.5, 1.5, float("nan"), rng.random()]), rng.choice(["same prefix a", "same prefix b", "same prefix", "", None, "é"]),
             rng.randrange(3), rng.random() < 0.5) for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, x double, s string, k int, b boolean").withColumn("t", F.timestamp_seconds(F.col("id") % 50)).cache()
    for order in ([Key("x"), Key("id")], [Key("s", ascending=False), Key("x", nulls_first=False), Key("id", False)], ["k", "b", "s", "id"],
                  [Key("t", False), Key("s", True, False), "id"], [Key("x", False, True), "s", "id"]):
        sort = [(k if isinstance(k, Key) else Key(k)).sort() for k in order]
        want = [r.id for r in df.orderBy(*sort).collect()]
        for first in (0, 95, 2000, 5990, 6000, 9000):
            assert [r.id for r in rows_at(df, order, first, 20, few=100).collect()] == want[first:first + 20], (order, first)
    hot = spark.range(50_000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS k")
    plan = rows_at(hot, ["k", "id"], 30_000, 50, few=1000)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan and "Scan ExistingRDD" not in plan
    df.unpersist()


def test_codes_that_grow(spark, scratch):
    from sparkprep.functions.code_table import CodeTable
    codes = CodeTable(spark, os.path.join(scratch, "codes"))
    frame = lambda values: spark.createDataFrame([(v, i) for i, v in enumerate(values)], "c string, code int")
    assert codes.version() == 0 and codes.extend(frame([]), "c") == 0
    assert codes.extend(frame(["m", "b", None, "m"]), "c") == 1
    first = {r.value: r.code for r in codes.rows().collect()}
    assert first == {"b": 0, "m": 1}
    assert codes.extend(frame(["m", "b"]), "c") == 1  # nothing new
    assert codes.extend(frame(["z", "a", "b", "", None]), "c") == 2
    assert {r.value: r.code for r in codes.rows().collect()} == {**first, "": 2, "a": 3, "z": 4}
    rows = frame(["a", "b", None, "never"])
    assert [r.c for r in codes.encode(rows, "c").orderBy("code").collect()] == [3, 0, -1, -1]
    assert [r.c for r in codes.encode(rows, "c", version=1).orderBy("code").collect()] == [-1, 0, -1, -1]


def test_diff_of_bucketed_tables(spark):
    from sparkprep.operators.diff import DiffTables, deleted_rows, updated_cells
    rows = [(i, i % 7 if i % 5 else None, f"t{i % 3}" if i % 4 else None, float(i) if i % 6 else float("nan"), [i % 2, None]) for i in range(2000)]
    before = spark.createDataFrame(rows, "k long, n int, s string, x double, a array<int>")
    after = before.where("k % 11 <> 0").select("k", F.col("n").cast("double").alias("n"), F.when(F.col("k") % 50 == 0, "new").otherwise(F.col("s")).alias("s"),
                                               F.when(F.col("k") % 90 == 0, 0.5).otherwise(F.col("x")).alias("x"),
                                               F.when(F.col("k") % 70 == 0, F.array(F.lit(9))).otherwise(F.col("a")).alias("a"), F.lit(1).alias("extra"))
    d = DiffTables(before, after, "k", buckets=4)
    want = sorted(map(tuple, updated_cells(before, after, "k").collect()))
    assert len(want) > 50 and sorted(map(tuple, d.updated_cells().collect())) == want
    assert sorted(d.deleted_rows().collect()) == deleted_rows(before, after, "k").collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for out in (d.updated_cells(), d.deleted_rows()):
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan
        slim = d.changed_rows()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in slim and "v0" not in slim
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = spark.createDataFrame([(1, None, 2, [None, 5]), (2, 1, 1, [5])], "k int, p int, q int, a array<int>")
    back = spark.createDataFrame([(1, 2, None, [5, None]), (2, 1, 1, [5])], moved.schema)
    assert sorted(map(tuple, DiffTables(moved, back, "k", buckets=2).updated_cells().collect())) == [(1, "a"), (1, "p"), (1, "q")]
    same = DiffTables(before, before, "k", buckets=3)
    assert same.updated_cells().count() == 0 and same.deleted_rows().count() == 0
    keys = DiffTables(before.select("k"), after.select("k"), "k", buckets=2)
    assert keys.updated_cells().count() == 0
