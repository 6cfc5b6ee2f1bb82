"""The cleaning sequence in its fixed order and its change log.

Order: de-duplicate -> drop rows with nulls -> fill -> drop columns -> remove
outliers. Each step is fitted on the previous step's output. When a later step
needs statistics and an earlier step shuffles (de-duplication), the
intermediate is written to the shared checkpoint folder, once: the fits and every
reader of the output go on from there.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.clean import DropColumns, FillNulls, RemoveDuplicates, RemoveNulls, RemoveOutliers
from ..session import cut_lineage
from .base import FittedStep


@dataclass
class CleanSpec:
    remove_duplicates: bool = False
    duplicate_subset: list[str] | None = None
    remove_nulls: bool = False
    null_columns: list[str] | None = None
    fill_nulls: dict = field(default_factory=dict)
    drop_columns: list[str] = field(default_factory=list)
    remove_outliers: bool = False
    outlier_columns: list[str] | None = None
    outlier_method: str = "iqr"
    outlier_factor: float = 1.5
    row_key: str = "_orig_idx"
    exact: bool = True          # False: one-pass approximate quantiles for median fill / IQR


@dataclass
class CleanResult:
    steps: list[FittedStep]
    stages: list[tuple[str, DataFrame]]     # (step name, output) after every step
    output: DataFrame

    def change_log(self) -> DataFrame:
        return change_log(self.stages)

    def details(self) -> list[dict]:
        """Per step the fitted details (columns, strategy/value, bounds,
        method, factor) -- fitted parameters only, no data rows."""
        return [{"step": i + 1, "step_type": name, **(f.meta or {})}
                for i, ((name, _), f) in enumerate(zip(self.stages[1:], self.steps))]

    def details_frame(self, spark) -> DataFrame:
        """C13 as rows: one per step and column (fitted parameters only)."""
        rows = []
        for d in self.details():
            method, factor = d.get("method"), d.get("factor")
            bounds = d.get("bounds") or {}
            if isinstance(d.get("summary"), list) and d["summary"] and isinstance(d["summary"][0], dict):
                rows += [(d["step"], d["step_type"], n["column"], n["strategy"], None if n["value"] is None else str(n["value"]),
                          None, None, method, factor) for n in d["summary"]]
                continue
            columns = d.get("columns")
            for c in columns if isinstance(columns, list) else ["*"]:
                b = bounds.get(c, {})
                rows.append((d["step"], d["step_type"], c, None, None, b.get("lower"), b.get("upper"), method, factor))
        return spark.createDataFrame(rows, "step int, operation string, column string, strategy string, value string, "
                                           "lower double, upper double, method string, factor double")


def run_cleaning(df: DataFrame, spec: CleanSpec) -> CleanResult:
    planned = []
    if spec.remove_duplicates:
        planned.append(("remove_duplicates", RemoveDuplicates(spec.duplicate_subset, spec.row_key)))
    if spec.remove_nulls:
        planned.append(("remove_nulls", RemoveNulls(spec.null_columns)))
    if spec.fill_nulls:
        planned.append(("fill_nulls", FillNulls(spec.fill_nulls, spec.exact)))
    if spec.drop_columns:
        planned.append(("drop_columns", DropColumns(spec.drop_columns)))
    if spec.remove_outliers:
        planned.append(("remove_outliers", RemoveOutliers(spec.outlier_columns, spec.outlier_method,
                                                          spec.outlier_factor, (spec.row_key,), spec.exact)))
    cur, steps, stages = df, [], [("input", df)]
    needs_stats = {"fill_nulls", "remove_outliers"}
    for i, (name, step) in enumerate(planned):
        fitted = step.fit(cur)
        cur = fitted.transform(cur)
        steps.append(fitted)
        stages.append((name, cur))
        later = {n for n, _ in planned[i + 1:]}
        if name == "remove_duplicates" and later & needs_stats:
            cur = cut_lineage(cur)
            stages[-1] = (name, cur)
    return CleanResult(steps, stages, cur)


KEEPS_ROWS = ("fill_nulls", "drop_columns")


def change_log(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """``(step, operation, rows_before, rows_after, rows_removed, columns_after)``
    as a lazy DataFrame. Only steps that may remove rows are counted; the others
    have the rows of the step before. The windows run over one row per step."""
    parts = []
    for i, (name, d) in enumerate(stages):
        counted = d.agg(F.count(F.lit(1)).alias("n")) if name not in KEEPS_ROWS else d.sparkSession.range(1).select(F.lit(None).cast("long").alias("n"))
        parts.append(counted.select(F.lit(i).alias("step"), F.lit(name).alias("operation"), "n", F.lit(len(d.columns)).alias("columns_after")))
    w = Window.orderBy("step")  # one row per step: bounded by the step count
    allp = reduce(DataFrame.unionByName, parts).withColumn("rows_after", F.last("n", ignorenulls=True).over(w)).drop("n")
    return (allp.withColumn("rows_before", F.lag("rows_after").over(w))
            .where(F.col("step") > 0)
            .select("step", "operation", "rows_before", "rows_after",
                    (F.col("rows_before") - F.col("rows_after")).alias("rows_removed"), "columns_after"))
