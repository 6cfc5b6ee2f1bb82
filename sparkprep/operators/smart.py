"""Quality-report-driven imputation, outlier handling and scaling.

Decisions come from the quality report (per-column statistics); the work is
narrow projections/filters with literal statistics. Statistics that depend on
an earlier column's change are refitted on the current frame, as the
sequential reference does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..functions.stats import bias_corrected_skew
from ..functions.types import dtypes, is_numeric, is_text, present, qcol
from .clean import mode_values
from .encode import distinct_sets
from .profile import quality_report

def clip_to_iqr(df: DataFrame, columns, factor: float = 1.5) -> DataFrame:
    """C17: winsorise to the IQR fences; NULL stays NULL."""
    qs = exact_quantiles(df, columns, [0.25, 0.75])
    exprs = []
    for c in df.columns:
        if c in qs and qs[c][0] is not None:
            q1, q3 = qs[c]
            lo, hi = q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)
            x = qcol(c)
            exprs.append(F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x))).alias(c))
        else:
            exprs.append(qcol(c))
    return df.select(*exprs)


def smart_imputation(df: DataFrame, report: dict | None = None, exclude: tuple = (),
                     max_dummies: int | None = None, measures: tuple = ()) -> DataFrame:
    """>50 % missing -> drop; categorical <10 % -> mode else indicator columns
    (with a ``<col>_nan`` flag); numeric <10 % -> median else the column mean
    (a one-column nearest-neighbour imputer has no distance for a missing row).
    Each category becomes a column, so the schema holds them all; ``max_dummies``
    raises beyond that many (no limit by default).

    The report calls a numeric column categorical, too, if its distinct values are under a tenth of the
    rows; any column of fixed precision comes to that as its table grows. ``measures`` names
    the columns that are numeric whatever that share is."""
    report = report or quality_report(df, exclude=exclude)
    types = dtypes(df)
    out = df
    for c in [c for c in df.columns if c in report["missing_data"]]:
        pct = report["missing_data"][c]["percentage"]
        info = report["data_types"][c]
        if pct > 50:
            out = out.drop(c)
            continue
        if is_text(types[c]) or (info["is_categorical"] and c not in measures):
            if pct < 10:
                m = mode_values(out, [c])[c]
                out = out.withColumn(c, F.coalesce(qcol(c), F.lit(m if m is not None else "Unknown")
                                                   .cast(types[c])))
            else:
                values = distinct_sets(out, [c], max_dummies)[c]
                if values is None:
                    raise ValueError(f"column '{c}' has more than {max_dummies} categories for indicators")
                keep = [qcol(x) for x in out.columns if x != c]
                flags = [F.coalesce((qcol(c) == F.lit(v)).cast("tinyint"), F.lit(0).cast("tinyint"))
                         .alias(f"{c}_{v}") for v in values]
                flags.append(qcol(c).isNull().cast("tinyint").alias(f"{c}_nan"))
                out = out.select(*keep, *flags)
        else:
            if pct < 10:
                v = exact_quantiles(out, [c], [0.5])[c][0]
            else:
                v = out.agg(F.avg(present(c, types[c]))).collect()[0][0]
            out = out.withColumn(c, F.coalesce(qcol(c).cast("double"), F.lit(v).cast("double")))
    return out


def smart_outliers(df: DataFrame, report: dict | None = None, exclude: tuple = ()) -> DataFrame:
    """Outlier share >20 % -> robust scale; >5 % -> clip to the fences;
    else drop rows outside the fences (NULL rows too, as the comparison fails)."""
    report = report or quality_report(df, exclude=exclude)
    out = df
    for c in [f.name for f in df.schema.fields if is_numeric(f.dataType)]:
        if c not in report["outliers"]:
            continue
        pct = report["outliers"][c]["percentage"]
        q1, med, q3 = exact_quantiles(out, [c], [0.25, 0.5, 0.75])[c]
        if q1 is None:
            continue
        iqr = q3 - q1
        lo, hi = q1 - 1.5 * iqr, q3 + 1.5 * iqr
        x = qcol(c)
        if pct > 20:
            out = out.withColumn(c, (x.cast("double") - F.lit(med)) / F.lit(iqr if iqr else 1.0))
        elif pct > 5:
            out = out.withColumn(c, F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x))))
        else:
            out = out.where((x >= lo) & (x <= hi))
    return out


def smart_scaling(df: DataFrame, exclude: tuple = ()) -> DataFrame:
    """|bias-corrected skew| > 1 -> robust scaling, else standard scaling."""
    cols = [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in exclude]
    if not cols:
        return df
    types = dtypes(df)
    row = df.agg(*[e for c in cols for e in (bias_corrected_skew(present(c, types[c]).cast("double")).alias(f"k_{c}"),
                                              F.avg(present(c, types[c])).alias(f"m_{c}"), F.stddev_pop(present(c, types[c])).alias(f"s_{c}"))]
                 ).collect()[0]
    robust = [c for c in cols if row[f"k_{c}"] is not None and abs(row[f"k_{c}"]) > 1]
    qs = exact_quantiles(df, robust, [0.25, 0.5, 0.75])
    exprs = []
    for c in df.columns:
        x = qcol(c).cast("double")
        if c in robust:
            q1, med, q3 = qs[c]
            exprs.append(((x - F.lit(med)) / F.lit((q3 - q1) or 1.0)).alias(c))
        elif c in cols:
            exprs.append(((x - F.lit(row[f"m_{c}"])) / F.lit(row[f"s_{c}"] or 1.0)).alias(c))
        else:
            exprs.append(qcol(c))
    return df.select(*exprs)
