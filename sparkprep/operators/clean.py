"""Cleaning operators C2-C11 and C14.

Every fit is one aggregate job over all columns of the step (quantiles use the
exact distributed helper); every transform is a narrow projection or filter
with the fitted values as literals, except keep-first de-duplication, which is
one partially aggregated ``groupBy``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.quantiles import quantiles
from ..functions.types import dtypes, is_numeric, is_text, missing, numeric_columns, present, qcol
from ..plans.base import FittedStep, register

ROW_ID = "_orig_idx"


# ----------------------------------------------------------------------------- C2
@register
class FittedDedupe(FittedStep):
    kind = "remove_duplicates"

    def transform(self, df: DataFrame) -> DataFrame:
        order = self.params.get("order_by")
        cols = df.columns
        subset = self.params.get("subset") or [c for c in cols if c != order and c != ROW_ID]
        if not order or order not in cols:
            return df.dropDuplicates(subset)
        if set(subset) | {order} >= set(cols) and order not in subset:
            # full-row: keep the smallest row key of each group
            keys = {c: f"_k{i}" for i, c in enumerate(subset)}
            grouped = df.groupBy(*[qcol(c).alias(k) for c, k in keys.items()]).agg(F.min(qcol(order)).alias("_o"))
            return grouped.select(*[F.col("_o").alias(c) if c == order else F.col(keys[c]).alias(c) for c in cols])
        # keep-first: min_by is partially aggregated, so a hot key collapses
        # map-side instead of landing whole in one task
        first = F.min_by(F.struct(*[qcol(c) for c in cols]), qcol(order)).alias("_first")
        return df.groupBy(*[qcol(c).alias(f"_k{i}") for i, c in enumerate(subset)]).agg(first) \
                 .select("_first.*")


@dataclass
class RemoveDuplicates:
    subset: list[str] | None = None
    order_by: str | None = ROW_ID

    def fit(self, df: DataFrame) -> FittedDedupe:
        subset = [c for c in (self.subset or []) if c in df.columns] or None
        return FittedDedupe({"subset": subset, "order_by": self.order_by},
                            {"operation": "Remove Duplicates", "columns": subset or "all"})


# ----------------------------------------------------------------------------- C3
@register
class FittedDropNulls(FittedStep):
    kind = "remove_nulls"

    def transform(self, df: DataFrame) -> DataFrame:
        cols = self.params.get("columns")
        cols = cols or df.columns
        types = dtypes(df)
        keep = F.lit(True)
        for c in cols:
            keep = keep & ~missing(c, types[c])
        return df.where(keep)


@dataclass
class RemoveNulls:
    columns: list[str] | None = None

    def fit(self, df: DataFrame) -> FittedDropNulls:
        cols = [c for c in (self.columns or []) if c in df.columns] or None
        return FittedDropNulls({"columns": cols},
                               {"operation": "Remove Nulls", "columns": cols or "all"})


# ----------------------------------------------------------------------------- C4-C7
def mode_values(df: DataFrame, columns) -> dict:
    """Most frequent non-null value per column, smallest value on ties.
    ``groupBy(c).count()`` is partially aggregated; top-1 is a TakeOrdered."""
    out = {}
    types = dtypes(df)
    for c in columns:
        top = (df.select(present(c, types[c]).alias("_v")).where("_v IS NOT NULL").groupBy("_v").agg(F.count("*").alias("_n"))
               .orderBy(F.desc("_n"), F.asc("_v")).limit(1).collect())
        out[c] = top[0][0] if top else None
    return out


@register
class FittedFill(FittedStep):
    kind = "fill_nulls"

    def transform(self, df: DataFrame) -> DataFrame:
        fills = self.params["values"]
        types = dtypes(df)
        exprs = []
        for c in df.columns:
            if c in fills and fills[c] is not None:
                v = F.lit(fills[c])
                if self.params["strategies"][c] in ("mean", "median"):
                    exprs.append(F.when(missing(c, types[c]), v.cast("double"))
                                 .otherwise(qcol(c).cast("double")).alias(c))
                else:
                    exprs.append(F.when(missing(c, types[c]), v.cast(types[c])).otherwise(qcol(c)).alias(c))
            else:
                exprs.append(qcol(c))
        return df.select(*exprs)


@dataclass
class FillNulls:
    """``strategies``: ``{column: {"strategy": mean|median|mode|custom, "value": v}}``."""
    strategies: dict = field(default_factory=dict)
    exact: bool = True

    def fit(self, df: DataFrame) -> FittedFill:
        types = dtypes(df)
        plan = {c: ((s or {}).get("strategy") or "mean").lower()
                for c, s in self.strategies.items() if c in types}
        for c, s in plan.items():
            if s in ("mean", "median") and not is_numeric(types[c]):
                raise TypeError(f"cannot fill column '{c}' with {s}: it is not numeric")
        means = [c for c, s in plan.items() if s == "mean"]
        values: dict = {}
        if means:
            row = df.agg(*[F.avg(present(c, types[c])) for c in means]).collect()[0]
            values.update(dict(zip(means, row)))
        meds = [c for c, s in plan.items() if s == "median"]
        values.update({c: q[0] for c, q in quantiles(df, meds, [0.5], self.exact).items()})
        values.update(mode_values(df, [c for c, s in plan.items() if s == "mode"]))
        for c, s in plan.items():
            if s not in ("custom", "mean", "median", "mode"):
                values[c] = None
        values.update(_custom_values(df, {c: self.strategies[c].get("value") for c, s in plan.items() if s == "custom"}, types))
        values = {c: _jsonable(v) for c, v in values.items()}
        notes = [{"operation": "Fill Nulls", "column": c, "strategy": plan[c], "value": values[c],
                  **({"note": "no fill value; column unchanged"} if values[c] is None else {})}
                 for c in sorted(plan)]
        return FittedFill({"values": values, "strategies": plan}, {"summary": notes})


def _custom_values(df: DataFrame, given: dict, types: dict) -> dict:
    """The given values as their columns' types; one row for all of them."""
    out = {c: None if raw is None else str(raw) for c, raw in given.items()}
    typed = [c for c, raw in given.items() if raw is not None and not is_text(types[c])]
    if typed:
        row = df.sparkSession.range(1).select(*[F.lit(out[c]).try_cast(types[c]) for c in typed]).first()
        for c, v in zip(typed, row, strict=True):
            if v is None:
                raise TypeError(f"custom fill value {given[c]!r} does not fit column '{c}' of type {types[c].simpleString()}")
            out[c] = v
    return out


def _jsonable(v):
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if v.__class__.__name__ == "Decimal":
        return float(v)
    return v


# ----------------------------------------------------------------------------- C8
@register
class FittedDropColumns(FittedStep):
    kind = "drop_columns"

    def transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*[c for c in self.params["columns"] if c in df.columns])


@dataclass
class DropColumns:
    columns: list[str] = field(default_factory=list)

    def fit(self, df: DataFrame) -> FittedDropColumns:
        existing = [c for c in self.columns if c in df.columns]
        return FittedDropColumns({"columns": existing},
                                 {"operation": "Drop Columns", "columns": existing})


# ----------------------------------------------------------------------------- C9-C11
def outlier_keep_condition(bounds: dict, types: dict | None = None) -> Column:
    """``lower <= x <= upper or x is null`` per column, AND over columns. Integral
    columns compare with integer bounds (same rows, no cast on the column), so
    the predicate reaches the Parquet scan."""
    cond = F.lit(True)
    for c, b in bounds.items():
        if b.get("lower") is None or b.get("upper") is None:
            continue
        x, lo, hi = qcol(c), b["lower"], b["upper"]
        if types and isinstance(types.get(c), T.IntegralType) and math.isfinite(lo) and math.isfinite(hi):
            lo, hi = F.lit(math.ceil(lo)).cast(types[c]), F.lit(math.floor(hi)).cast(types[c])
        gap = missing(c, types[c]) if types and c in types else x.isNull()
        cond = cond & ((x >= lo) & (x <= hi) | gap)
    return cond


@register
class FittedOutliers(FittedStep):
    kind = "remove_outliers"

    def transform(self, df: DataFrame) -> DataFrame:
        bounds = self.params["bounds"]
        if not bounds:
            return df
        if self.params.get("method") == "zscore":
            cond = F.lit(True)
            for c, b in bounds.items():
                if b.get("lower") is not None:
                    cond = cond & zscore_keep_condition(c, b["mean"], b["std"], b["z_threshold"])
            return df.where(cond)
        return df.where(outlier_keep_condition(bounds, dtypes(df)))


def iqr_bounds(df: DataFrame, columns, factor: float = 1.5, exact: bool = True) -> dict:
    qs = quantiles(df, columns, [0.25, 0.75], exact)
    out = {}
    for c, (q1, q3) in qs.items():
        if q1 is None:
            out[c] = {"lower": None, "upper": None}
            continue
        iqr = q3 - q1
        out[c] = {"lower": q1 - factor * iqr, "upper": q3 + factor * iqr, "q1": q1, "q3": q3}
    return out


def zscore_bounds(df: DataFrame, columns, factor: float = 3.0) -> dict:
    if not columns:
        return {}
    types = dtypes(df)
    row = df.agg(*[e for i, c in enumerate(columns) for e in
                   (F.avg(present(c, types[c])).alias(f"m_{i}"), F.stddev_pop(present(c, types[c])).alias(f"s_{i}"))]).collect()[0]
    out = {}
    for i, c in enumerate(columns):
        mu, sd = row[f"m_{i}"], row[f"s_{i}"]
        if not sd:  # zero or undefined spread keeps every row
            out[c] = {"lower": None, "upper": None, "mean": mu or 0.0, "std": sd or 0.0}
        else:
            out[c] = {"lower": mu - factor * sd, "upper": mu + factor * sd, "mean": mu, "std": sd,
                      "z_threshold": factor}
    return out


METHOD_NAMES = {"iqr": "IQR", "zscore": "Z-Score"}  # fixed values of the change log


@dataclass
class RemoveOutliers:
    columns: list[str] | None = None
    method: str = "iqr"
    factor: float = 1.5
    exclude: tuple = (ROW_ID,)
    exact: bool = True

    def fit(self, df: DataFrame) -> FittedOutliers:
        method = (self.method or "iqr").lower()
        numeric = numeric_columns(df, exclude=self.exclude)
        cols = [c for c in self.columns if c in numeric] if self.columns else numeric
        if not cols:
            return FittedOutliers({"bounds": {}}, {"summary": ["no numeric column to bound"]})
        if method == "iqr":
            bounds = iqr_bounds(df, cols, float(self.factor), self.exact)
        elif method == "zscore":
            bounds = zscore_bounds(df, cols, float(self.factor))
        else:
            return FittedOutliers({"bounds": {}},
                                  {"summary": [f"no outlier method {method!r}; rows are kept"]})
        return FittedOutliers({"bounds": bounds, "method": method},
                              {"operation": "Remove Outliers",
                               "method": METHOD_NAMES[method],
                               "factor": float(self.factor), "columns": cols, "bounds": bounds})


def zscore_keep_condition(c: str, mean: float, std: float, factor: float) -> Column:
    """The literal z-score rule ``abs((x-mu)/sigma) <= f or x is null``."""
    x = qcol(c)
    return (F.abs((x - F.lit(mean)) / F.lit(std)) <= factor) | x.isNull() | F.isnan(x.cast("double"))


# ----------------------------------------------------------------------------- C14
ID_LIKE_COLUMNS = ("_orig_idx", "customer_id", "id", "index", "row_id", "uuid", "key")  # fixed values


def drop_identifier_columns(df: DataFrame) -> DataFrame:
    keep = [c for c in df.columns if c.lower() not in ID_LIKE_COLUMNS]
    return df.select(*[qcol(c) for c in keep]) if keep else df
