"""Polynomial powers, datetime parts and group aggregates broadcast back."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import dtypes, is_datetime, is_numeric_or_bool, is_text, present, qcol
from ..plans.base import FittedStep, register

DATETIME_PARTS = ("year", "month", "day", "hour", "minute", "second")  # fixed suffixes
AGGREGATIONS = ("sum", "mean", "min", "max", "count")


def as_timestamp(c: str, dt) -> Column:
    if is_datetime(dt):
        return qcol(c)
    if is_text(dt):
        return F.try_to_timestamp(qcol(c))
    return F.lit(None).cast("timestamp")


PART_FUNCS = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour,
              "minute": F.minute, "second": F.second}


def group_aggregate_table(df: DataFrame, group: str, values, how: str) -> DataFrame:
    """Per-group statistic of every value column; partially aggregated."""
    aggs = []
    for i, v in enumerate(values):
        x = qcol(v)
        if how == "sum":
            aggs.append(F.coalesce(F.sum(x), F.lit(0)).alias(f"_g{i}"))
        elif how == "mean":
            aggs.append(F.avg(x).alias(f"_g{i}"))
        elif how == "min":
            aggs.append(F.min(x).alias(f"_g{i}"))
        elif how == "max":
            aggs.append(F.max(x).alias(f"_g{i}"))
        else:
            aggs.append(F.count(x).alias(f"_g{i}"))
    return df.where(qcol(group).isNotNull()).groupBy(qcol(group).alias("_gk")).agg(*aggs)


def row_combine(n: int, how: str) -> Column:
    gs = [F.col(f"_g{i}") for i in range(n)]
    if how in ("sum", "count"):
        return sum((F.coalesce(g, F.lit(0)) for g in gs[1:]), F.coalesce(gs[0], F.lit(0)))
    if how == "mean":
        total = sum((F.coalesce(g.cast("double"), F.lit(0.0)) for g in gs[1:]),
                    F.coalesce(gs[0].cast("double"), F.lit(0.0)))
        present = sum((g.isNotNull().cast("int") for g in gs[1:]), gs[0].isNotNull().cast("int"))
        return F.try_divide(total, present)
    if how == "min":
        return F.least(*gs) if n > 1 else gs[0]
    return F.greatest(*gs) if n > 1 else gs[0]


@register
class FittedCreation(FittedStep):
    kind = "feature_creation"

    def reads(self) -> list[str]:
        p = self.params
        return [p["group"], *p["values"]] if p["method"] == "aggregations" else list(p["columns"])

    def makes(self) -> dict[str, str]:
        p = self.params
        if p["method"] == "aggregations":
            return {p["new_column"]: p["group"]}
        if p["method"] == "polynomial":
            return {f"{c}^{d}": c for c in p["columns"] for d in range(2, p["degree"] + 1)}
        return {f"{c}_{part}": c for c in p["columns"] for part in p.get("parts", DATETIME_PARTS)}

    def transform(self, df: DataFrame) -> DataFrame:
        p = self.params
        method = p["method"]
        types = dtypes(df)
        if method == "polynomial":
            out = df
            for c in p["columns"]:
                x = qcol(c).cast("double")
                powers, cur = [], x
                for d in range(2, p["degree"] + 1):
                    cur = cur * x  # repeated products, as the reference's expansion
                    powers.append(cur.alias(f"{c}^{d}"))
                out = out.select(*[x.alias(c) if k == c else qcol(k) for k in out.columns], *powers)
            return out
        if method == "datetime_decomposition":
            extra = []
            for c in p["columns"]:
                ts = as_timestamp(c, types[c])
                extra += [PART_FUNCS[part](ts).alias(f"{c}_{part}") for part in p.get("parts", DATETIME_PARTS)]
            return df.select("*", *extra)
        # aggregations: group statistic per value column, joined back on the key
        group, values, how, name = p["group"], p["values"], p["aggregation"], p["new_column"]
        table = group_aggregate_table(df, group, values, how)
        base = df.drop(name) if name in df.columns else df
        joined = base.join(table, qcol(group) == F.col("_gk"), "left")
        keep = [qcol(c) for c in df.columns if c != name]
        return joined.select(*keep, row_combine(len(values), how).alias(name))


@dataclass
class FeatureCreation:
    columns: list[str] = field(default_factory=list)
    method: str = "polynomial"
    degree: int | None = 2
    date_part: str | None = None      # accepted, unused (as in the reference)
    aggregation_type: str | None = None
    new_column_name: str | None = None
    parts: tuple = DATETIME_PARTS

    def fit(self, df: DataFrame) -> FittedCreation:
        fits = {"polynomial": (self._polynomial, ("degree",)), "datetime_decomposition": (self._dates, ()),
                "aggregations": (self._aggregations, ("aggregation_type", "new_column_name"))}
        if self.method not in fits:
            raise ValueError(f"feature creation has no method {self.method!r}")
        fit, needed = fits[self.method]
        unset = [n for n in needed if getattr(self, n) is None]
        if unset:
            raise ValueError(f"{self.method} needs {' and '.join(unset)}")
        params, details = fit(df, dtypes(df))
        return FittedCreation({"method": self.method, **params},
                              {"operation": "Feature Creation", "method": self.method, "columns": list(self.columns), "details": details})

    def _polynomial(self, df: DataFrame, types: dict) -> tuple[dict, dict]:
        known = [c for c in self.columns if c in types]
        numeric = [c for c in known if is_numeric_or_bool(types[c])]
        filled = set()
        if numeric:
            counts = df.agg(*[F.count(present(c, types[c])).alias(f"n{i}") for i, c in enumerate(numeric)]).collect()[0]
            filled = {c for i, c in enumerate(numeric) if counts[f"n{i}"]}
        why = {c: f"powers up to {self.degree}" if c in filled else "left out: no values" if c in numeric else "left out: not numeric" for c in known}
        return {"columns": [c for c in known if c in filled], "degree": int(self.degree)}, why

    def _dates(self, df: DataFrame, types: dict) -> tuple[dict, dict]:
        known = [c for c in self.columns if c in types]
        return {"columns": known, "parts": list(self.parts)}, dict.fromkeys(known, "date parts")

    def _aggregations(self, df: DataFrame, types: dict) -> tuple[dict, dict]:
        absent = [c for c in self.columns if c not in types]
        if absent:
            raise ValueError(f"not in the table: {', '.join(absent)}")
        if len(self.columns) < 2:
            raise ValueError("aggregations need a group column and a value column")
        if self.aggregation_type not in AGGREGATIONS:
            raise ValueError(f"no aggregation {self.aggregation_type!r}; there are {', '.join(AGGREGATIONS)}")
        group, *values = self.columns
        return ({"group": group, "values": values, "aggregation": self.aggregation_type, "new_column": self.new_column_name},
                {"aggregation": {"group": group, "values": values, "type": self.aggregation_type, "new_col": self.new_column_name}})
