"""Evaluation as aggregates over the prediction table.

Classification metrics come from the confusion table (one ``groupBy``);
ROC-AUC is exact (average ranks, ties averaged) via a running total over the
distinct scores (range-partitioned, no single-task window); regression
metrics are one aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rank import with_running_total
from ..functions.types import qcol


def confusion_table(pred: DataFrame, y: str, yhat: str) -> DataFrame:
    """``(actual, predicted, count)`` over the sorted union of labels, zero-filled."""
    counts = pred.groupBy(qcol(y).alias("actual"), qcol(yhat).alias("predicted")).agg(F.count(F.lit(1)).alias("count"))
    labels = counts.select(F.col("actual").alias("v")).unionByName(counts.select(F.col("predicted").alias("v"))).where("v IS NOT NULL").distinct()
    # every class against every class: that is what a confusion matrix holds
    grid = labels.withColumnRenamed("v", "actual").crossJoin(labels.withColumnRenamed("v", "predicted"))
    return (grid.join(counts, ["actual", "predicted"], "left")
            .select("actual", "predicted", F.coalesce("count", F.lit(0)).cast("bigint").alias("count")))


def classification_metrics(confusion: DataFrame) -> DataFrame:
    """Accuracy and support-weighted precision/recall/F1 (0 where undefined)."""
    per = (confusion.groupBy(F.col("actual").alias("c")).agg(F.sum("count").alias("support"),
                                                              F.sum(F.when(F.col("actual") == F.col("predicted"),
                                                                           F.col("count"))).alias("tp"))
           .join(confusion.groupBy(F.col("predicted").alias("c")).agg(F.sum("count").alias("predicted_n")), "c", "full"))
    per = per.select(F.coalesce("support", F.lit(0)).alias("support"), F.coalesce("tp", F.lit(0)).alias("tp"),
                     F.coalesce("predicted_n", F.lit(0)).alias("pn"))
    p = F.when(F.col("pn") > 0, F.col("tp") / F.col("pn")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = F.when((p + r) > 0, 2 * p * r / (p + r)).otherwise(0.0)
    n = F.sum("support")
    return per.agg((F.sum("tp") / n).alias("accuracy"), (F.sum(p * F.col("support")) / n).alias("precision"),
                   (F.sum(r * F.col("support")) / n).alias("recall"), (F.sum(f1 * F.col("support")) / n).alias("f1_score"))


def roc_auc(pred: DataFrame, y: str, score: str, positive=1) -> DataFrame:
    """Exact binary ROC-AUC = (sum of positive average ranks - n1(n1+1)/2) / (n1 n0)."""
    groups = (pred.where(qcol(score).isNotNull() & qcol(y).isNotNull())
              .groupBy(qcol(score).cast("double").alias("s"))
              .agg(F.count(F.when(qcol(y) == F.lit(positive), 1)).alias("pos"), F.count(F.lit(1)).alias("n")))
    run = with_running_total(groups, ["s"], "n", "cum")
    avg_rank = F.col("cum") - F.col("n") + (F.col("n") + 1) / 2.0
    agg = run.agg(F.sum(F.col("pos") * avg_rank).alias("rs"), F.sum("pos").alias("n1"),
                  (F.sum("n") - F.sum("pos")).alias("n0"))
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    return agg.select(F.try_divide(F.col("rs") - n1 * (n1 + 1) / 2, n1 * n0).alias("roc_auc"))


def regression_metrics(pred: DataFrame, y: str, yhat: str, p: int = 1) -> DataFrame:
    e = qcol(y).cast("double") - qcol(yhat).cast("double")
    s = pred.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"),
                 F.var_pop(qcol(y).cast("double")).alias("vy"))
    r2 = 1 - F.col("mse") / F.col("vy")
    adj = F.when(F.col("n") > p + 1, 1 - (1 - r2) * (F.col("n") - 1) / (F.col("n") - p - 1)).otherwise(r2)
    return s.select("mae", "mse", F.sqrt("mse").alias("rmse"), r2.alias("r2_score"), adj.alias("adjusted_r2"))


def residuals(pred: DataFrame, key, y: str, yhat: str, k: int = 1000) -> DataFrame:
    """First ``k`` residuals in key order (a top-k report)."""
    keys = [key] if isinstance(key, str) else list(key)
    return (pred.select(*keys, (qcol(y).cast("double") - qcol(yhat).cast("double")).alias("residual"))
            .orderBy(*keys).limit(k))
