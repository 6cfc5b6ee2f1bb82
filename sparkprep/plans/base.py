"""Step contract: ``Step.fit(df) -> FittedStep``; ``FittedStep.transform(df)``.

Fitted parameters are plain JSON (numbers, strings, lists). Dictionaries too
large to inline are tables: they live in the shared checkpoint folder while
the session runs and are written next to the JSON on ``save``.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession

REGISTRY: dict[str, type] = {}


def register(cls):
    REGISTRY[cls.kind] = cls
    return cls


class FittedStep:
    kind = "base"

    def __init__(self, params: dict, meta: dict | None = None, tables: dict | None = None):
        self.params = params
        self.meta = meta or {}
        self.tables: dict[str, DataFrame] = tables or {}

    def transform(self, df: DataFrame) -> DataFrame:  # pragma: no cover - interface
        raise NotImplementedError

    def to_dict(self) -> dict:
        return {"kind": self.kind, "params": self.params, "meta": self.meta}

    def reads(self) -> list[str]:
        """Columns that ``transform`` needs."""
        return []

    def makes(self) -> dict[str, str]:
        """Columns that ``transform`` adds, and the column that each is made from."""
        return {}

    def save(self, path: str, index: int = 0) -> dict:
        d = self.to_dict()
        d["tables"] = {}
        for name, t in self.tables.items():
            tp = os.path.join(path, f"step{index}_{name}.parquet")
            t.write.mode("overwrite").parquet(tp)
            d["tables"][name] = tp
        return d

    @staticmethod
    def load(spark: SparkSession, d: dict) -> "FittedStep":
        cls = REGISTRY[d["kind"]]
        tables = {k: spark.read.parquet(v) for k, v in (d.get("tables") or {}).items()}
        return cls(d["params"], d.get("meta"), tables)


def save_steps(steps: list[FittedStep], path: str) -> None:
    os.makedirs(path, exist_ok=True) if "://" not in path else None
    docs = [s.save(path, i) for i, s in enumerate(steps)]
    spark = SparkSession.getActiveSession()
    (spark.createDataFrame([(json.dumps(docs),)], "doc string").coalesce(1)
     .write.mode("overwrite").text(os.path.join(path, "steps.json")))


def load_steps(spark: SparkSession, path: str) -> list[FittedStep]:
    doc = spark.read.text(os.path.join(path, "steps.json")).first()[0]
    return [FittedStep.load(spark, d) for d in json.loads(doc)]
