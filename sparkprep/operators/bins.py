"""Equal-width and quantile binning into ``<col>_binned`` codes.

Both are right-closed with the lowest edge included (``pd.cut``/``pd.qcut``
with ``labels=False``). Edges are fitted once (min/max in one aggregate, or the
exact distributed quantiles) and the code is a literal ``CASE`` chain.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles
from ..functions.types import dtypes, is_numeric, qcol
from ..plans.base import FittedStep, register

WIDEN = 0.001  # relative widening of the range (fixed value of the rule)


def equal_width_edges(lo: float, hi: float, k: int) -> list[float]:
    if lo == hi:
        pad = WIDEN * abs(lo) if lo != 0 else WIDEN
        return [float(v) for v in np.linspace(lo - pad, hi + pad, k + 1)]
    edges = np.linspace(lo, hi, k + 1)
    edges[0] -= (hi - lo) * WIDEN
    return [float(v) for v in edges]


def quantile_edges(qs: list[float]) -> list[float]:
    return [float(v) for v in np.unique(np.asarray(qs, dtype="float64"))]


def bin_code(x: Column, edges: list[float]) -> Column:
    """Index i with edges[i] < x <= edges[i+1]; x == edges[0] -> 0; outside -> NULL."""
    if len(edges) < 2:
        return F.lit(None).cast("int")
    expr = F.when(x < F.lit(edges[0]), F.lit(None).cast("int"))
    for i, e in enumerate(edges[1:]):
        expr = expr.when(x <= F.lit(e), F.lit(i))
    return expr


@register
class FittedBinning(FittedStep):
    kind = "binning"

    def reads(self) -> list[str]:
        return list(self.params["edges"])

    def makes(self) -> dict[str, str]:
        return {f"{c}_binned": c for c in self.params["edges"]}

    def transform(self, df: DataFrame) -> DataFrame:
        edges = self.params["edges"]
        return df.select("*", *[bin_code(qcol(c).cast("double"), e).alias(f"{c}_binned")
                               for c, e in edges.items()])


@dataclass
class Binning:
    columns: list[str] = field(default_factory=list)
    method: str = "equal-width"
    bins: int = 5
    column_methods: dict = field(default_factory=dict)
    exact: bool = True

    def fit(self, df: DataFrame) -> FittedBinning:
        types = dtypes(df)
        details, plan = {}, {}
        for c in self.columns:
            if c not in types:
                details[c] = "skipped (column not found)"
            elif not is_numeric(types[c]):
                details[c] = "skipped (non-numeric)"
            else:
                m = self.column_methods.get(c, self.method)
                if m in ("equal-width", "quantile"):
                    plan[c] = m
                else:
                    details[c] = f"skipped (unknown method: {m})"
        k = int(self.bins)
        edges = {}
        width_cols = [c for c, m in plan.items() if m == "equal-width"]
        if width_cols:
            row = df.agg(*[e for c in width_cols for e in
                           (F.min(qcol(c).cast("double")).alias(f"lo_{c}"),
                            F.max(qcol(c).cast("double")).alias(f"hi_{c}"))]).collect()[0]
            for c in width_cols:
                lo, hi = row[f"lo_{c}"], row[f"hi_{c}"]
                edges[c] = [] if lo is None else equal_width_edges(lo, hi, k)
                details[c] = "equal-width binned"
        q_cols = [c for c, m in plan.items() if m == "quantile"]
        probs = [float(p) for p in np.linspace(0, 1, k + 1)]
        for c, qs in quantiles(df, q_cols, probs, self.exact).items():
            edges[c] = [] if qs[0] is None else quantile_edges(qs)
            details[c] = "quantile binned"
        ordered = {c: edges[c] for c in self.columns if c in edges}
        return FittedBinning({"edges": ordered, "bins": k},
                             {"operation": "Binning", "method": self.method, "columns": list(self.columns),
                              "bins": k, "details": details})
