"""Correlations of many columns in one scan, against numpy and the aggregate expressions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkprep.operators import gram, select


def made(rng, n, c):
    x = rng.normal(size=(n, c)) * 10.0 ** rng.integers(-3, 4, c) + rng.normal(size=c) * 1e4
    x[:, 1] = 2 * x[:, 0] + 1
    x[:, 2] = 7.25
    x[rng.random((n, c)) < 0.2] = np.nan
    x[:, 3] = np.nan
    return x


def brute(x, i, j):
    both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
    a, b = x[both, i], x[both, j]
    return None if len(a) < 2 or a.std() == 0 or b.std() == 0 else abs(np.corrcoef(a, b)[0, 1])


def frame(spark, x, parts):
    rows = [[None if np.isnan(v) and k % 2 else float(v) for k, v in enumerate(row)] for row in x]
    return spark.createDataFrame(rows, ", ".join(f"`c {i}` double" for i in range(x.shape[1]))).repartition(parts)


def test_correlations_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(gram, "TILE", 5)
    monkeypatch.setattr(gram, "FAN", 2)
    x = made(np.random.default_rng(1), 400, 26)
    df = frame(spark, x, 7)
    got = {(r.col_a, r.col_b): r.abs_corr for r in select.correlation_pairs(df, df.columns, 0.9).collect()}
    assert len(got) == 26 * 25 // 2
    for i in range(26):
        for j in range(i + 1, 26):
            want, have = brute(x, i, j), got[f"c {i}", f"c {j}"]
            assert (have is None) if want is None else have == pytest.approx(want, abs=1e-9), (i, j)
    assert got["c 0", "c 1"] == pytest.approx(1)
    decided = {r["column"]: r["dropped"] for r in select.correlation_decisions(df, df.columns, 0.9).collect()}
    assert decided["c 1"] and not decided["c 2"] and not decided["c 3"] and sum(decided.values()) == 1


def test_both_forms_agree_on_constant_parts(spark, scratch):
    spark.range(2000).select(*[F.when(F.col("id") % (k + 2) > 0, (F.col("id") * k) % 13 if k % 4 else F.lit(0.25 * k)).cast("double").alias(f"x{k}") for k in range(12)]).write.parquet(f"{scratch}/t")
    df = spark.read.parquet(f"{scratch}/t")
    pairs = [(a, b) for i, a in enumerate(df.columns) for b in df.columns[i + 1:]]
    matrix = {(r.col_a, r.col_b): r.abs_corr for r in select._matrix_frame(df, df.columns).collect()}
    for r in select._pairs_frame(df, pairs).collect():
        have = matrix[r.col_a, r.col_b]
        assert (have is None) == (r.abs_corr is None) and (have is None or have == pytest.approx(r.abs_corr, abs=1e-9)), (r, have)


def test_a_thousand_columns_in_one_scan(spark, scratch):
    spark.range(300).select(*[F.when(F.col("id") % 7 != k % 7, F.sin(F.col("id") * (k + 1))).alias(f"x{k}") for k in range(1000)]).write.parquet(f"{scratch}/t")
    df = spark.read.parquet(f"{scratch}/t")
    out = select._matrix_frame(df, df.columns)
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert out.agg(F.count("abs_corr"), F.max("abs_corr") <= 1 + 1e-9).first() == (499_500, True)
