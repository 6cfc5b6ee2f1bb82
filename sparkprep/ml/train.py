"""Train every chosen model, evaluate, pick the best, save.

One prepared frame (split flag, train-only categorical codes, label index)
is persisted for all models and released at the end. Each model is a
``Pipeline(imputer -> assembler -> estimator)`` fitted on the training rows;
the models are fitted concurrently from driver threads (their jobs share the
executors); a failing model is recorded and does not stop the run.
"""

from __future__ import annotations

import json
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import dtypes, is_numeric_or_bool, is_text, qcol
from ..operators.profile import target_analysis
from ..operators.recommend import problem_type as problem_type_rule
from ..plans.base import FittedStep, save_steps
from .encode import apply_codes, fit_train_codes
from .metrics import classification_metrics, confusion_table, regression_metrics, roc_auc
from .registry import classification_models, regression_models
from .split import prepare_split

SUSPICIOUS = 0.99


@dataclass
class TrainingResult:
    problem_type: str
    target: str
    features: list[str]
    results: list[dict]
    best_model: str | None
    warnings: list[str]
    models: dict = field(default_factory=dict)          # name -> PipelineModel
    dictionaries: dict = field(default_factory=dict)    # categorical codes (train only)
    classes: list | None = None                         # label index -> class
    counts: dict = field(default_factory=dict)          # rows, train_rows, test_rows

    def results_frame(self, spark) -> DataFrame:
        rows = [(r["model"], r["status"], r.get("score"), json.dumps(r.get("metrics", {})), r.get("training_time"),
                 r.get("error")) for r in self.results]
        return spark.createDataFrame(rows, "model string, status string, score double, metrics string, "
                                           "training_time double, error string")


def detect_problem_type(df: DataFrame, target: str) -> str:
    return problem_type_rule(target_analysis(df, target)).collect()[0]["problem_type"]


def feature_columns(df: DataFrame, target: str, key: str) -> tuple[list[str], list[str]]:
    types = dtypes(df)
    skip = {target, key, "is_test"}
    cats = [c for c, t in types.items() if c not in skip and is_text(t)]
    nums = [c for c, t in types.items() if c not in skip and is_numeric_or_bool(t)]
    return nums, cats


def prepare(df: DataFrame, target: str, key: str, ptype: str, test_size: float, seed: int):
    split, warnings, counts = prepare_split(df, target, key, test_size, seed)
    nums, cats = feature_columns(split, target, key)
    dictionaries = fit_train_codes(split.where(~F.col("is_test")), cats) if cats else {}
    coded = apply_codes(split, dictionaries)
    classes = None
    if ptype == "classification":
        # as many as the model itself holds: each has its coefficients or trees there
        classes = sorted(r[0] for r in coded.select(qcol(target)).distinct().collect())
        coded = with_label(coded, target, classes)
    else:
        coded = coded.withColumn("label", qcol(target).cast("double"))
    feats = nums + cats
    coded = coded.select(qcol(key), "is_test", "label", qcol(target),
                         *positional(feats))
    return coded, feats, dictionaries, classes, warnings, counts


def with_label(df: DataFrame, target: str, classes: list) -> DataFrame:
    """``label``, the index of the row's class; the classes are broadcast, as a shuffle by them would put all rows of
    a class into one task."""
    shape = T.StructType([T.StructField("_class", dtypes(df)[target]), T.StructField("label", T.DoubleType())])
    codes = df.sparkSession.createDataFrame([(v, float(i)) for i, v in enumerate(classes)], shape)
    return df.join(F.broadcast(codes), qcol(target) == F.col("_class"), "left").drop("_class")


def positional(feats: list[str]) -> list[Column]:
    """The features by their places: model stages don't take every name that a column may have."""
    return [qcol(c).cast("double").alias(f"_f{i}") for i, c in enumerate(feats)]


def _pipeline(n_features: int, estimator) -> Pipeline:
    given, imputed = ([f"{name}{i}" for i in range(n_features)] for name in ("_f", "_imp"))
    return Pipeline(stages=[Imputer(inputCols=given, outputCols=imputed, strategy="mean"),
                            VectorAssembler(inputCols=imputed, outputCol="features", handleInvalid="keep"),
                            estimator])


def evaluate(pred: DataFrame, ptype: str, n_classes: int) -> dict:
    if ptype == "classification":
        cm = confusion_table(pred, "label", "prediction")
        m = classification_metrics(cm).collect()[0].asDict()
        if n_classes == 2 and "probability" in pred.columns:
            scored = pred.select("label", vector_to_array("probability")[1].alias("p1"))
            m["roc_auc"] = roc_auc(scored, "label", "p1", 1.0).collect()[0]["roc_auc"]
        return m
    return regression_metrics(pred, "label", "prediction").collect()[0].asDict()


def feature_importance(model: PipelineModel, feats: list[str]) -> list[tuple[str, float]]:
    est = model.stages[-1]
    if hasattr(est, "featureImportances"):
        vals = list(est.featureImportances.toArray())
    elif hasattr(est, "coefficientMatrix"):
        mat = est.coefficientMatrix.toArray()
        vals = [float(abs(mat[:, j]).mean()) for j in range(mat.shape[1])]
    elif hasattr(est, "coefficients"):
        vals = [abs(float(v)) for v in est.coefficients.toArray()]
    else:
        return []
    return sorted(zip(feats, [float(v) for v in vals]), key=lambda t: -t[1])


def select_best(results: list[dict], order: list[str]) -> tuple[str | None, list[str]]:
    ok = [r for r in results if r["status"] == "completed" and r.get("score") is not None]
    if not ok:
        errors = "; ".join(f"{r['model']}: {r.get('error')}" for r in results)
        raise RuntimeError(f"no model trained successfully ({errors})")
    best = sorted(ok, key=lambda r: (-r["score"], order.index(r["model"])))[0]
    warn = [f"Suspiciously high score ({best['score']:.4f}) for {best['model']}: check for target leakage"] \
        if best["score"] >= SUSPICIOUS else []
    return best["model"], warn


def run_training(df: DataFrame, target: str, key: str, models: list[str] | None = None,
                 test_size: float = 0.2, seed: int = 42, problem_type: str | None = None,
                 parallelism: int = 4) -> TrainingResult:
    if target not in df.columns:
        raise ValueError(f"Target column '{target}' not found in dataset")
    ptype = problem_type or detect_problem_type(df, target)
    registry = classification_models() if ptype == "classification" else regression_models()
    chosen = [m for m in (models or list(registry)) if m in registry]
    coded, feats, dictionaries, classes, warnings, counts = prepare(df, target, key, ptype, test_size, seed)
    coded = coded.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        train, test = coded.where(~F.col("is_test")), coded.where(F.col("is_test"))
        ctx = {"n_train": counts["train_rows"], "n_classes": len(classes or []),
               "sigma_y": train.agg(F.stddev_pop("label")).collect()[0][0] or 0.0}
        def fit_one(name):
            t0 = time.time()
            try:
                model = _pipeline(len(feats), registry[name](ctx)).fit(train)
                metrics = evaluate(model.transform(test), ptype, ctx["n_classes"])
                score = metrics.get("accuracy") if ptype == "classification" else metrics.get("r2_score")
                return model, {"model": name, "status": "completed", "score": score, "metrics": metrics,
                               "training_time": time.time() - t0,
                               "feature_importance": feature_importance(model, feats)}
            except Exception as e:  # noqa: BLE001 - recorded, the run goes on
                return None, {"model": name, "status": "failed", "error": str(e)[:6000],
                              "training_time": time.time() - t0}

        # model-level parallelism: each fit's jobs are submitted from its own
        # driver thread and share the executors (results kept in registry order)
        with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(chosen)))) as pool:
            done = list(pool.map(fit_one, chosen))
        results = [r for _, r in done]
        fitted = {r["model"]: m for m, r in done if m is not None}
        best, warn = select_best(results, chosen)
        return TrainingResult(ptype, target, feats, results, best, warnings + warn, fitted, dictionaries, classes, counts)
    finally:
        coded.unpersist()


def _best(result: TrainingResult) -> dict:
    best = next((r for r in result.results if r["model"] == result.best_model), {})
    return {"score": best.get("score"), "metrics": {k: float(v) for k, v in best.get("metrics", {}).items() if isinstance(v, (int, float))}}


def save_training(result: TrainingResult, base_dir: str, model_name: str | None = None,
                  filename: str | None = None, steps: list[FittedStep] | None = None) -> str:
    """``<base>/<id>/model`` (PipelineModel), codes as tables, results JSON with the
    file trained on, its size, and the best model's score and metrics. ``steps`` are the fitted feature
    steps that made the training table: with them, rows can be scored as they were before (M26)."""
    model_id = uuid.uuid4().hex[:12]
    name = model_name or result.best_model
    root = f"{base_dir.rstrip('/')}/{model_id}"
    result.models[name].save(f"{root}/model")
    codes = {}
    for c, d in result.dictionaries.items():
        if "codes" in d:
            codes[c] = {"codes": d["codes"]}
        else:
            d["table"].write.mode("overwrite").parquet(f"{root}/codes_{c}.parquet")
            codes[c] = {"path": f"{root}/codes_{c}.parquet", "size": d["size"]}
    if steps:
        save_steps(steps, f"{root}/steps")
    doc = {"model_id": model_id, "steps": f"{root}/steps" if steps else None, "model_name": name, "problem_type": result.problem_type,
           "target_column": result.target, "features": result.features, "classes": result.classes,
           "codes": codes, "best_model": result.best_model,
           "filename": filename, "dataset_info": {**result.counts, "features": len(result.features)},
           **_best(result),
           "results": [{k: v for k, v in r.items() if k != "feature_importance"} for r in result.results],
           "created_at": time.strftime("%Y-%m-%dT%H:%M:%S")}
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(doc),)], "doc string").coalesce(1).write.mode("overwrite") \
        .text(f"{root}/{model_id}_results.json")
    return root
