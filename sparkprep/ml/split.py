"""M1-M4: target null filter, deterministic hash split, stratified split, warnings.

The split is a pure function of the row key and the seed (no shuffle, no
sampling state): ``bucket = int(md5(key || seed)[0:8], 16) % 10000`` and a row
is in the test set when ``bucket < test_size * 10000``. The stratified split
finds each class's threshold of a 60-bit hash from counts, so a dominant class
is never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.types import qcol
from ..session import cut_lineage

SEED = 42
HASH_BITS = 60
STEP_BITS = 12  # hash bits per refinement of a class threshold


def split_bucket(key: Column, seed: int = SEED) -> Column:
    h = F.md5(F.concat(key.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % 10000


def split_hash(key: Column, seed: int = SEED) -> Column:
    h = F.md5(F.concat(key.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint")


def hash_split(df: DataFrame, key: str, test_size: float = 0.2, seed: int = SEED) -> DataFrame:
    """Adds boolean ``is_test``."""
    if not 0.1 <= test_size <= 0.5:
        raise ValueError("test_size must be between 0.1 and 0.5")
    # a NULL key has no hash: such rows stay on the training side instead of vanishing
    return df.withColumn("is_test", F.coalesce(split_bucket(qcol(key), seed) < int(round(test_size * 10000)),
                                               F.lit(False)))


def stratified_split(df: DataFrame, key: str, label: str, test_size: float = 0.2, seed: int = SEED) -> DataFrame:
    """Inside each class (NULL is one) the first ``round(test_size * n_class)`` rows
    by (hash, key) are test rows. Rows that share a key stay together, and rows
    with a NULL key are never test rows.

    Only counts move: rows per class and leading hash bits (combined before the
    shuffle) give the hash range in which each class reaches its quota, a second round
    narrows that range, and the few rows in it give the class's last
    test row. The thresholds -- one row per class -- are joined back."""
    hashed = df.select(qcol(key).alias("_k"), qcol(label).alias("_y"), split_hash(qcol(key), seed).alias("_h"))
    quota = F.least(F.floor(F.count(F.lit(1)) * test_size + 0.5), F.count("_h"))
    open_ = hashed.groupBy("_y").agg(quota.alias("_rest")).where("_rest > 0").select(F.col("_y").alias("_c"), "_rest")
    rows = hashed.where("_h IS NOT NULL").join(open_, F.col("_y").eqNullSafe(F.col("_c"))).drop("_c")
    for step in (1, 2):
        group = F.shiftright("_h", HASH_BITS - step * STEP_BITS)
        found = _crossing(rows.groupBy("_y", group.alias("_g")).agg(F.count(F.lit(1)).alias("_n"), F.max("_rest").alias("_rest")), ["_g"])
        found = found.select(F.col("_y").alias("_c"), F.col("_g").alias("_cg"), F.col("_left").alias("_rest"))
        rows = rows.drop("_rest").join(found, F.col("_y").eqNullSafe(F.col("_c")) & (group == F.col("_cg"))).drop("_c", "_cg")
    last = _crossing(rows.groupBy("_y", "_h", "_k").agg(F.count(F.lit(1)).alias("_n"), F.max("_rest").alias("_rest")), ["_h", "_k"])
    last = cut_lineage(last.select(F.col("_y").alias("_c"), F.struct("_h", "_k").alias("_last")))
    place = F.struct(split_hash(qcol(key), seed).alias("_h"), qcol(key).alias("_k"))
    joined = df.withColumn("_place", place).join(last, qcol(label).eqNullSafe(F.col("_c")), "left")
    is_test = F.coalesce((F.col("_place")["_h"].isNotNull()) & (F.col("_place") <= F.col("_last")), F.lit(False))
    return joined.withColumn("is_test", is_test).drop("_place", "_last", "_c")


def _crossing(counted: DataFrame, order: list[str]) -> DataFrame:
    """Per class the group in which the running count reaches ``_rest``; ``_left`` is
    what is wanted from that group. A class has a bounded number of groups here."""
    run = W.partitionBy("_y").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    upto = counted.withColumn("_upto", F.sum("_n").over(run))
    return upto.where("_upto >= _rest AND _upto - _n < _rest").withColumn("_left", F.col("_rest") - F.col("_upto") + F.col("_n"))


# The texts in the next function are fixed values: they are part of the results to match.
def prepare_split(df: DataFrame, target: str, key: str, test_size: float = 0.2, seed: int = SEED):
    """M1-M4: drop null targets, stratify when < 10 classes and >= 20 rows.
    Returns ``(frame with is_test, warnings, counts)``."""
    data = df.where(qcol(target).isNotNull())
    stats = data.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(target).alias("k")).collect()[0]
    if stats["k"] < 10 and stats["n"] >= 20:
        out = stratified_split(data, key, target, test_size, seed)
    else:
        out = hash_split(data, key, test_size, seed)
    n_test = out.where("is_test").count()
    warnings = []
    if stats["n"] < 100:
        warnings.append(f"Very small dataset ({stats['n']} samples). Results may not be reliable.")
    if n_test < 20:
        warnings.append(f"Very small test set ({n_test} samples). Consider using cross-validation.")
    return out, warnings, {"rows": stats["n"], "test_rows": n_test, "train_rows": stats["n"] - n_test}
