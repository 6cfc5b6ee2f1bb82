"""Load a saved model and score new rows by replaying exactly the
fitted steps: train-only categorical codes, the fitted imputer/assembler and
the estimator. Output: class, confidence (probability of the predicted
class) and a class -> probability map; regression: the value.
"""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encode import apply_codes
from .train import positional
from ..functions.types import qcol
from ..plans.base import FittedStep, load_steps
from ..plans.features import replay


class SavedModel:
    def __init__(self, model: PipelineModel, doc: dict, dictionaries: dict, steps: list[FittedStep] | None = None):
        self.model, self.doc, self.dictionaries, self.steps = model, doc, dictionaries, steps or []

    @property
    def features(self) -> list[str]:
        return self.doc["features"]


def load_model(spark: SparkSession, root: str) -> SavedModel:
    doc = json.loads(spark.read.text(f"{root.rstrip('/')}/*_results.json").first()[0])
    dictionaries = {}
    for c, d in doc["codes"].items():
        dictionaries[c] = ({"codes": d["codes"]} if "codes" in d
                           else {"table": spark.read.parquet(d["path"]), "size": d["size"]})
    steps = load_steps(spark, doc["steps"]) if doc.get("steps") else []
    return SavedModel(PipelineModel.load(f"{root.rstrip('/')}/model"), doc, dictionaries, steps)


def raw_columns(steps: list[FittedStep]) -> list[str]:
    """Columns that a table must have for the steps: what they read and no earlier step makes."""
    made, out = set(), []
    for step in steps:
        out += [c for c in step.reads() if c not in made and c not in out]
        made |= set(step.makes())
    return out


def rebuild(df: DataFrame, saved: SavedModel) -> DataFrame:
    """The features of raw rows, by replaying the steps that were fitted with the model. Which
    column a feature comes from is known from the steps' dictionaries; its name is never taken apart."""
    absent = [c for c in raw_columns(saved.steps) if c not in df.columns]
    if absent:
        raise ValueError(f"Missing required columns: {', '.join(absent)}")
    return replay(df, saved.steps, drop_ids=False)


def missing_features(df: DataFrame, features: list[str]) -> list[str]:
    """Expected columns absent from the input."""
    return [c for c in features if c not in df.columns]


def extra_columns(df: DataFrame, features: list[str], keep: tuple = ()) -> list[str]:
    return [c for c in df.columns if c not in features and c not in keep]


def looks_raw(df: DataFrame, features: list[str]) -> bool:
    """Raw rows if some ``base`` of a ``base_x`` feature is an input column,
    or fewer than 70 % of the features are present."""
    present = sum(1 for c in features if c in df.columns)
    bases = {c.rsplit("_", 1)[0] for c in features if "_" in c}
    return bool(bases & set(df.columns)) or present < 0.7 * max(len(features), 1)


def align_to_schema(df: DataFrame, features: list[str], keep: tuple = ()) -> DataFrame:
    """M26 fallback: missing feature -> 0, non-numeric -> try_cast else 0, extra dropped, order kept."""
    cols = [F.coalesce(qcol(c).try_cast("double"), F.lit(0.0)).alias(c) if c in df.columns
            else F.lit(0.0).alias(c) for c in features]
    return df.select(*[qcol(k) for k in keep if k in df.columns], *cols)


def predict(saved: SavedModel, df: DataFrame, keep: tuple = (), align: bool = False, raw: bool | None = None) -> DataFrame:
    """Score rows. A model saved with its feature steps takes rows with all of its features as they are, and
    makes the features of others by replaying the steps (M25, M26); ``raw`` says which of both, where steps
    change columns in place and names can't tell. Without steps, missing features raise; with
    ``align=True`` rows that look raw (M25) are brought to the model's schema first, where a feature that isn't there is 0."""
    if saved.steps and (bool(missing_features(df, saved.features)) if raw is None else raw):
        df = rebuild(df, saved)
    elif align and looks_raw(df, saved.features):
        others = [c for c in df.columns if c not in saved.features]
        texts = [c for c in saved.features if c in saved.dictionaries]
        fixed = align_to_schema(df, [c for c in saved.features if c not in texts], tuple(others) + tuple(c for c in texts if c in df.columns))
        df = fixed.withColumns({c: F.lit(None).cast("string") for c in texts if c not in df.columns})
    missing = missing_features(df, saved.features)
    if missing:
        raise ValueError(f"Missing required columns: {', '.join(missing)}")
    kept = [c for c in keep if c in saved.features]
    coded = apply_codes(df, saved.dictionaries)
    ready = coded.select(*[qcol(c) for c in df.columns if c not in saved.features],
                         *[qcol(c).alias(f"_kept_{i}") for i, c in enumerate(kept)], *positional(saved.features))
    out = saved.model.transform(ready)
    passthrough = [qcol(c) if c not in saved.features else F.col(f"_kept_{kept.index(c)}").alias(c)
                   for c in df.columns if c not in saved.features or c in kept]
    if saved.doc["problem_type"] != "classification":
        return out.select(*passthrough, F.col("prediction").alias("predicted_value"))
    classes = saved.doc["classes"]
    cls = F.element_at(F.array(*[F.lit(str(v)) for v in classes]), F.col("prediction").cast("int") + 1)
    given = vector_to_array("probability")  # a class that only test rows have may be unknown to the model
    probs = F.concat(given, F.array_repeat(F.lit(0.0), F.lit(len(classes)) - F.size(given)))
    pmap = F.map_from_arrays(F.array(*[F.lit(str(v)) for v in classes]), probs)
    return out.select(*passthrough, cls.alias("predicted_class"), F.array_max(probs).alias("confidence"),
                      pmap.alias("probabilities"))
