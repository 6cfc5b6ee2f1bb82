"""Correlation filter, variance threshold and PCA.

The correlation filter's statistics are aggregates with a pairwise-complete
Pearson expression per column pair (small fixed buffers, no data moved) up to 256 pairs; those of
wider tables are summed up in matrices (``gram.py``). Either takes one scan. The
decision table is a DataFrame
(``correlation_pairs``) so it can be checked against SQL. PCA uses
``pyspark.ml`` on centred columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import pairwise_corr
from ..functions.types import dtypes, is_numeric, is_numeric_or_bool, present, text_literal
from ..plans.base import FittedStep, register
from .gram import correlations


def selection_columns(df: DataFrame, columns) -> list[str]:
    types = dtypes(df)
    if not columns:
        return [c for c, t in types.items() if is_numeric(t)]
    return [c for c in columns if c in types and is_numeric_or_bool(types[c])]


PAIRS_AS_EXPRESSIONS = 256    # bounds the aggregate expressions of a plan (3 buffers per pair)


def _pairs_frame(df: DataFrame, pairs) -> DataFrame:
    types = dtypes(df)
    x = lambda c: present(c, types[c]).cast("double")
    # merged deviations of a constant column needn't be exactly 0
    varies = {c: F.min(x(c)) < F.max(x(c)) for c in dict.fromkeys(c for pair in pairs for c in pair)}
    stats = df.agg(*[F.when(varies[a] & varies[b], F.abs(pairwise_corr(x(a), x(b)))).alias(f"_p{i}") for i, (a, b) in enumerate(pairs)])
    stack = ", ".join(f"{text_literal(a)}, {text_literal(b)}, `_p{i}`" for i, (a, b) in enumerate(pairs))
    return stats.selectExpr(f"stack({len(pairs)}, {stack}) as (col_a, col_b, abs_corr)")


def _matrix_frame(df: DataFrame, columns: list[str]) -> DataFrame:
    names = F.array(*[F.lit(c) for c in columns])
    return correlations(df, columns).select(names[F.col("a")].alias("col_a"), names[F.col("b")].alias("col_b"), F.abs("corr").alias("abs_corr"))


def correlation_pairs(df: DataFrame, columns, threshold: float) -> DataFrame:
    """Long table ``(col_a, col_b, abs_corr, exceeds)`` for every pair a before b
    (pairwise-complete Pearson; NULL where a column is constant)."""
    columns = list(columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, abs_corr double, exceeds boolean")
    out = _pairs_frame(df, pairs) if len(pairs) <= PAIRS_AS_EXPRESSIONS else _matrix_frame(df, columns)
    return out.withColumn("exceeds", F.coalesce(F.col("abs_corr") > F.lit(float(threshold)), F.lit(False)))


def correlation_decisions(df: DataFrame, columns, threshold: float) -> DataFrame:
    """``(column, dropped)``: dropped when any earlier column correlates above the threshold."""
    pairs = correlation_pairs(df, columns, threshold)
    return pairs.groupBy(F.col("col_b").alias("column")).agg(F.max("exceeds").alias("dropped"))


def variance_table(df: DataFrame, columns, threshold: float) -> DataFrame:
    """``(column, variance, kept)`` with the population variance."""
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, variance double, kept boolean")
    types = dtypes(df)
    stats = df.agg(*[F.var_pop(present(c, types[c]).cast("double")).alias(f"_v{i}") for i, c in enumerate(columns)])
    stack = ", ".join(f"{text_literal(c)}, `_v{i}`" for i, c in enumerate(columns))
    return (stats.selectExpr(f"stack({len(columns)}, {stack}) as (column, variance)")
            .withColumn("kept", F.coalesce(F.col("variance") > F.lit(float(threshold)), F.lit(False))))


@register
class FittedSelection(FittedStep):
    kind = "feature_selection"

    def reads(self) -> list[str]:
        p = self.params
        return list(p["kept"] if p["method"] == "variance_threshold" else p["initial"] if p["method"] == "pca" else [])

    def makes(self) -> dict[str, str]:
        p = self.params
        return {f"pca_component_{i + 1}": p["initial"][0] for i in range(len(p["components"]))} if p["method"] == "pca" else {}

    def transform(self, df: DataFrame) -> DataFrame:
        p = self.params
        if p["method"] == "correlation_filter":
            return df.drop(*p.get("dropped", []))
        if p["method"] == "variance_threshold":
            initial, kept = p["initial"], p["kept"]
            return df.select(*[c for c in df.columns if c not in initial], *kept)
        if p["method"] == "pca":
            from ..ml.pca import apply_pca
            return apply_pca(df, p)
        return df


@dataclass
class FeatureSelection:
    columns: list[str] = field(default_factory=list)
    method: str = "correlation_filter"
    threshold: float | None = 0.95
    n_components: int | None = 2

    def fit(self, df: DataFrame) -> FittedSelection:
        fits = {"correlation_filter": (self._by_correlation, "threshold"), "variance_threshold": (self._by_variance, "threshold"),
                "pca": (self._by_pca, "n_components")}
        columns = selection_columns(df, self.columns)
        if self.columns and not columns:
            return self._done({"method": "none"}, {"info": "no numeric column among those given"})
        if self.method not in fits:
            raise ValueError(f"feature selection has no method {self.method!r}")
        fit, needed = fits[self.method]
        if getattr(self, needed) is None:
            raise ValueError(f"{self.method} needs {needed}")
        return self._done(*fit(df, columns))

    def _done(self, params: dict, details: dict) -> FittedSelection:
        return FittedSelection(params, {"operation": "Feature Selection", "method": self.method, "details": details})

    def _by_correlation(self, df: DataFrame, columns: list[str]) -> tuple[dict, dict]:
        if len(columns) < 2:
            return {"method": "none"}, {"info": "a correlation needs two numeric columns"}
        decided = correlation_decisions(df, columns, self.threshold).where("dropped").collect()  # at most one row per column
        gone = [c for c in columns if c in {r["column"] for r in decided}]
        return {"method": self.method, "dropped": gone}, {"dropped_columns": gone, "threshold": self.threshold}

    def _by_variance(self, df: DataFrame, columns: list[str]) -> tuple[dict, dict]:
        above = {r["column"] for r in variance_table(df, columns, self.threshold).where("kept").collect()}
        kept = [c for c in columns if c in above]
        if not kept:
            raise ValueError(f"no column varies by more than {self.threshold}")
        return ({"method": self.method, "initial": columns, "kept": kept},
                {"selected_columns": kept, "threshold": self.threshold})

    def _by_pca(self, df: DataFrame, columns: list[str]) -> tuple[dict, dict]:
        from ..ml.pca import fit_pca
        if self.n_components > len(columns):
            raise ValueError(f"{self.n_components} components from {len(columns)} columns")
        params = fit_pca(df, columns, int(self.n_components))
        return params, {"n_components": self.n_components, "explained_variance_ratio": params["explained_variance_ratio"]}
