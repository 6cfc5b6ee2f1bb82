"""Global positions and running totals in a total order, without
``Window.orderBy`` over the whole table (which pulls every row into one task).

The table is range-partitioned and sorted within partitions, then written to
the shared checkpoint folder (the sampled range bounds must not change between
the counting job and the numbering job). Per-partition counts or sums -- one
small row per partition -- are prefix-summed on the driver and joined back by
partition id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .types import qcol


def _num_parts(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return num_partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def _with_offsets(ranged: DataFrame, sizes: dict[int, float], dtype: str) -> DataFrame:
    """Join ``_off``, the sum of the sizes of all earlier partitions (one row per partition)."""
    acc, rows = (0.0 if dtype == "double" else 0), []
    for pid in sorted(sizes):
        rows.append((pid, acc))
        acc += sizes[pid] or 0
    table = ranged.sparkSession.createDataFrame(rows, f"_opid int, _off {dtype}")
    return ranged.join(F.broadcast(table), F.col("_pid") == F.col("_opid")).drop("_opid")


def with_global_index(df: DataFrame, order_cols, index_col: str = "_idx",
                      num_partitions: int | None = None, with_count: bool = False):
    """Add the 0-based position of every row in the order ``order_cols`` (names or
    sort expressions). The order must be total (unique keys) for a deterministic
    numbering. ``with_count=True`` also returns the row count (known from the partition sizes)."""
    n = _num_parts(df, num_partitions)
    ranged = (df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id()))
    ranged = cut_lineage(ranged)
    sizes = {r["_pid"]: r["c"] for r in ranged.groupBy("_pid").agg(F.count("*").alias("c")).collect()}
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    out = _with_offsets(ranged, sizes, "long").withColumn(index_col, F.col("_off") + local).drop("_pid", "_mid", "_off")
    return (out, int(sum(sizes.values()))) if with_count else out


def with_running_total(df: DataFrame, order_cols, value_col: str, out_col: str,
                       num_partitions: int | None = None) -> DataFrame:
    """Add the inclusive running sum of ``value_col`` in the order ``order_cols``
    (order must be total). Each range partition is summed in its sorted order, batch after
    batch, without another shuffle; the sum of the earlier partitions is added."""
    n = _num_parts(df, num_partitions)
    value = F.coalesce(qcol(value_col).cast("double"), F.lit(0.0))
    ranged = (df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
              .withColumn("_pid", F.spark_partition_id()).withColumn(out_col, value))

    def run(batches):
        total = 0.0
        for pdf in batches:
            if len(pdf):
                pdf[out_col] = total + pdf[out_col].cumsum()
                total = float(pdf[out_col].iloc[-1])
                yield pdf

    ranged = cut_lineage(ranged.mapInPandas(run, ranged.schema))
    sizes = {r["_pid"]: r["s"] for r in ranged.groupBy("_pid").agg(F.sum(value_col).cast("double").alias("s")).collect()}
    return _with_offsets(ranged, sizes, "double").withColumn(out_col, F.col("_off") + F.col(out_col)).drop("_pid", "_off")


def dense_codes(values: DataFrame, value_col: str, code_col: str = "code",
                num_partitions: int | None = None, with_count: bool = False):
    """Dictionary ``(value, code)``: code = 0-based position of the distinct
    value in ascending order (a global dense rank). The table is backed by the
    checkpointed ranged frame, so its content is fixed."""
    distinct = values.select(value_col).distinct()
    return with_global_index(distinct, [value_col], code_col, num_partitions, with_count)


__all__ = ["with_global_index", "with_running_total", "dense_codes"]
