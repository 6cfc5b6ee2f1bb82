"""One-hot, label and target-mean encoding.

* one-hot: categories are found with a HyperLogLog screen first; only columns
  that may have <= ``max_onehot`` values have their (bounded) distinct set
  collected, so an id column never reaches the driver. Indicator columns are
  one projection of ``tinyint`` literals comparisons.
* label: the dictionary is the sorted distinct text (NULL -> ``'nan'``) with a
  global dense rank; small dictionaries are kept with the step, large ones stay
  a checkpointed table; either is joined back (broadcast if its size in bytes
  allows, otherwise a shuffle join that AQE can split on skew).
* target: per-category mean from a partially aggregated ``groupBy``, joined
  back the same way (no window that would put a hot category in one task).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rank import dense_codes
from ..functions.types import dtypes, is_numeric_or_bool, is_text, qcol
from ..plans.base import FittedStep, register
from ..session import cut_lineage

MAX_ONEHOT = 100          # more distinct values -> label encoding (fixed rule)
INLINE_DICT = 1000        # dictionaries up to this size are kept with the fitted step
NULL_TEXT = "nan"         # text a missing value gets before label encoding


def lookup_join(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join on a fitted lookup table; inline tables are marked for broadcast, the size
    of others decides between broadcast and shuffle."""
    return df.join(table, on=key, how="left")


def distinct_sets(df: DataFrame, columns, limit: int | None) -> dict[str, list | None]:
    """Sorted distinct non-null values per column, or None when there are more
    than ``limit``. Two bounded jobs: an HLL screen, then ``collect_set`` only
    on columns the screen shows to be small. Without a limit (None), each column's values come as rows, not as one
    array in one task: as many as the columns that are made of them."""
    if not columns:
        return {}
    if limit is None:
        return {c: sorted(r[0] for r in df.select(qcol(c)).where(qcol(c).isNotNull()).distinct().collect()) for c in columns}
    screen = dict(zip(columns, df.agg(*[F.approx_count_distinct(qcol(c), 0.02) for c in columns]).collect()[0]))
    small = [c for c in columns if screen[c] <= limit * 1.5 + 10]
    out = {c: None for c in columns}
    if small:
        row = dict(zip(small, df.agg(*[F.array_sort(F.collect_set(qcol(c))) for c in small]).collect()[0]))
        for c in small:
            out[c] = row[c] if len(row[c]) <= limit else None
    return out


@register
class FittedEncoding(FittedStep):
    kind = "encoding"

    def reads(self) -> list[str]:
        return [c for part in ("onehot", "label", "target") for c in self.params[part]]

    def makes(self) -> dict[str, str]:
        """By the stored dictionary: names of values may hold any character."""
        dummies = {f"{c}_{v}": c for c, values in self.params["onehot"].items() for v in values}
        return dummies | {f"{c}_target_encoded": c for c in self.params["target"]}

    def transform(self, df: DataFrame) -> DataFrame:
        p = self.params
        onehot, label, target = p["onehot"], p["label"], p["target"]
        out = df
        for c, info in label.items():
            key = F.coalesce(qcol(c), F.lit(NULL_TEXT))
            if "codes" in info:
                t = df.sparkSession.createDataFrame(list(info["codes"].items()), "_lk string, _code long")
                t = F.broadcast(t)  # up to INLINE_DICT values, which aren't to gather the rows
            else:
                t = self.tables[f"label_{c}"].withColumnRenamed("value", "_lk").withColumnRenamed("code", "_code")
            cols = out.columns
            out = lookup_join(out.withColumn("_lk", key), t, "_lk") \
                .select(*[F.col("_code").cast("bigint").alias(c) if x == c else qcol(x) for x in cols])
        for c, info in target.items():
            name = f"{c}_target_encoded"
            if "means" in info:
                t = df.sparkSession.createDataFrame([tuple(m) for m in info["means"]], "_tv string, _mean double")
                t = F.broadcast(t)
            else:
                t = self.tables[f"target_{c}"].select(F.col("value").alias("_tv"), F.col("mean").alias("_mean"))
            out = out.join(t, qcol(c) == F.col("_tv"), "left").drop("_tv", c).withColumnRenamed("_mean", name)
        encoded = [f"{c}_target_encoded" for c in target]
        keep = [qcol(c) for c in out.columns if c not in onehot and c not in encoded]
        dummies = [F.coalesce((qcol(c) == F.lit(v)).cast("tinyint"), F.lit(0).cast("tinyint"))
                   .alias(f"{c}_{v}") for c, values in onehot.items() for v in values]
        return out.select(*keep, *dummies, *[qcol(c) for c in encoded])


@dataclass
class Encoding:
    columns: list[str] = field(default_factory=list)
    method: str = "one-hot"
    column_methods: dict = field(default_factory=dict)
    target_column: str = "target"

    def fit(self, df: DataFrame) -> FittedEncoding:
        types = dtypes(df)
        details, by_method = {}, {"one-hot": [], "label": [], "target": []}
        for c in self.columns:
            if c not in types:
                details[c] = "skipped (column not found)"
            elif not is_text(types[c]):
                details[c] = "skipped (non-categorical)"
            else:
                m = self.column_methods.get(c, self.method)
                if m in by_method:
                    by_method[m].append(c)
                else:
                    details[c] = f"skipped (unknown method: {m})"
        onehot = {}
        sets = distinct_sets(df, by_method["one-hot"], MAX_ONEHOT)
        for c in by_method["one-hot"]:
            if sets[c] is None:
                by_method["label"].append(c)  # high cardinality: forced to label encoding
                details[c] = "label encoded (auto: more than 100 distinct values)"
            else:
                onehot[c] = sets[c]
                details[c] = "one-hot encoded"
        label, tables = {}, {}
        label_cols = [c for c in self.columns if c in by_method["label"]]
        small = distinct_sets(df.select(*[F.coalesce(qcol(c), F.lit(NULL_TEXT)).alias(c)
                                          for c in label_cols]), label_cols, INLINE_DICT) if label_cols else {}
        for c in label_cols:
            if small[c] is not None:
                label[c] = {"codes": {v: i for i, v in enumerate(small[c])}}
            else:
                values = df.select(F.coalesce(qcol(c), F.lit(NULL_TEXT)).alias("value"))
                t, size = dense_codes(values, "value", "code", with_count=True)
                label[c] = {"size": size}
                tables[f"label_{c}"] = t
            details.setdefault(c, "label encoded")
        target = {}
        if by_method["target"]:
            tc = self.target_column
            if tc not in types or not is_numeric_or_bool(types[tc]):
                for c in by_method["target"]:
                    details[c] = "target encoding skipped (no target column)"
            else:
                for c in by_method["target"]:
                    # one aggregation, written to the shared checkpoint folder, then counted there
                    means = cut_lineage(df.where(qcol(c).isNotNull()).groupBy(qcol(c).alias("value"))
                                        .agg(F.avg(qcol(tc).cast("double")).alias("mean")))
                    n = means.count()
                    if n <= INLINE_DICT:
                        target[c] = {"means": [[r["value"], r["mean"]] for r in means.orderBy("value").collect()]}
                    else:
                        tables[f"target_{c}"] = means
                        target[c] = {"size": n}
                    details[c] = "target encoded (simplified)"
        return FittedEncoding({"onehot": onehot, "label": label, "target": target},
                              {"operation": "Encoding", "method": self.method,
                               "columns": list(self.columns), "details": details}, tables)
