"""Aggregate expressions with pandas semantics under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bias_corrected_skew(c: Column) -> Column:
    """pandas ``Series.skew``: adjusted Fisher-Pearson; 0 for a constant column,
    NULL below three values. Spark's ``skewness`` is the population moment."""
    n = F.count(c).cast("double")
    g1 = F.skewness(c)
    adj = F.sqrt(n * (n - 1)) / (n - 2)
    return (F.when(n < 3, F.lit(None).cast("double"))
            .when(F.var_pop(c) == 0, F.lit(0.0))
            .otherwise(g1 * adj))


def pairwise_corr(x: Column, y: Column) -> Column:
    """Pearson on rows where both are non-null (pandas ``DataFrame.corr``);
    NULL instead of an error when either side is constant."""
    both = x.isNotNull() & y.isNotNull()
    xs, ys = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(xs, ys), F.stddev_pop(xs) * F.stddev_pop(ys))

