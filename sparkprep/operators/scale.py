"""Scaling with per-column method overrides.

Fit = one aggregate job for every column and method (plus the exact quantile
passes for robust scaling); transform = one projection with literal constants.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles
from ..functions.types import dtypes, is_numeric, present, qcol
from ..plans.base import FittedStep, register

METHODS = ("standard", "minmax", "robust", "log")


def scaled_expr(c: str, method: str, p: dict):
    x = qcol(c).cast("double")
    if method == "log":
        return F.when(x.isNotNull(), F.log1p(F.greatest(x, F.lit(0.0))))
    return (x - F.lit(p["center"])) / F.lit(p["scale"])


@register
class FittedScaling(FittedStep):
    kind = "scaling"

    def reads(self) -> list[str]:
        return list(self.params["columns"])

    def transform(self, df: DataFrame) -> DataFrame:
        cols = self.params["columns"]
        return df.select(*[scaled_expr(c, cols[c]["method"], cols[c]).alias(c) if c in cols else qcol(c)
                           for c in df.columns])


@dataclass
class Scaling:
    columns: list[str] = field(default_factory=list)
    method: str = "standard"
    column_methods: dict = field(default_factory=dict)
    exact: bool = True

    def fit(self, df: DataFrame) -> FittedScaling:
        types = dtypes(df)
        details, plan = {}, {}
        for c in self.columns:
            if c not in types:
                details[c] = "skipped (column not found)"
            elif not is_numeric(types[c]):
                details[c] = "skipped (non-numeric)"
            else:
                m = self.column_methods.get(c, self.method)
                if m in METHODS:
                    plan[c] = m
                else:
                    details[c] = f"skipped (unknown method: {m})"
        aggs = []
        for c, m in plan.items():
            x = present(c, types[c]).cast("double")
            if m == "standard":
                aggs += [F.avg(x).alias(f"a_{c}"), F.stddev_pop(x).alias(f"b_{c}")]
            elif m == "minmax":
                aggs += [F.min(x).alias(f"a_{c}"), F.max(x).alias(f"b_{c}")]
        row = df.agg(*aggs).collect()[0] if aggs else None
        qs = quantiles(df, [c for c, m in plan.items() if m == "robust"], [0.25, 0.5, 0.75], self.exact)
        params = {}
        for c, m in plan.items():
            if m == "standard":
                sd = row[f"b_{c}"]
                params[c] = {"method": m, "center": row[f"a_{c}"], "scale": sd if sd else 1.0}
                details[c] = "scaled (standard)"
            elif m == "minmax":
                lo, hi = row[f"a_{c}"], row[f"b_{c}"]
                rng = (hi - lo) if lo is not None else None
                params[c] = {"method": m, "center": lo, "scale": rng if rng else 1.0}
                details[c] = "scaled (minmax)"
            elif m == "robust":
                q1, med, q3 = qs[c]
                iqr = (q3 - q1) if q1 is not None else None
                params[c] = {"method": m, "center": med, "scale": iqr if iqr else 1.0}
                details[c] = "scaled (robust)"
            else:
                params[c] = {"method": m}
                details[c] = "log1p transformation applied"
        return FittedScaling({"columns": params},
                             {"operation": "Scaling", "method": self.method,
                              "columns": list(self.columns), "details": details})
