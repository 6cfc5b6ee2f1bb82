"""The model registry, ``pyspark.ml`` estimators with parameters that
reproduce the reference's library defaults where Spark has an equivalent.

* logistic regression, C = 1: ``regParam = 1 / n_train``, no standardization;
* random forest: 100 trees, seed 42;
* gradient boosting: 100 rounds, depth 3, step 0.1 (more than two classes: softmax boosting, `boosting.py`);
* ridge, alpha = 1: ``regParam = alpha * sigma_y / n_train`` (normal solver);
* lasso, alpha = 1: ``regParam = alpha``, ``elasticNetParam = 1``;
* xgboost / lightgbm: registered only when their Spark packages import.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

from .boosting import SoftmaxBoosting

SEED = 42
TREES = 100
TREE_DEPTH = 30  # the deepest that Spark grows; the rule has no limit


def _optional():
    extra = {}
    try:  # pragma: no cover - not installed here
        from xgboost.spark import SparkXGBClassifier, SparkXGBRegressor
        extra["xgboost"] = (lambda ctx: SparkXGBClassifier(n_estimators=100, random_state=SEED),
                            lambda ctx: SparkXGBRegressor(n_estimators=100, random_state=SEED))
    except Exception:
        pass
    return extra


def classification_models(tree_depth: int = TREE_DEPTH) -> dict:
    reg = {
        "logistic_regression": lambda ctx: LogisticRegression(maxIter=1000, regParam=1.0 / max(ctx["n_train"], 1),
                                                              elasticNetParam=0.0, standardization=False),
        "random_forest": lambda ctx: RandomForestClassifier(numTrees=TREES, maxDepth=tree_depth, seed=SEED),
        "gradient_boosting": lambda ctx: (GBTClassifier(maxIter=100, maxDepth=3, stepSize=0.1, seed=SEED)
                                          if ctx["n_classes"] <= 2 else SoftmaxBoosting(maxIter=100, maxDepth=3, stepSize=0.1)),
    }
    for k, (c, _) in _optional().items():
        reg[k] = c
    return reg


def regression_models(tree_depth: int = TREE_DEPTH) -> dict:
    reg = {
        "linear_regression": lambda ctx: LinearRegression(regParam=0.0, solver="normal"),
        "ridge": lambda ctx: LinearRegression(elasticNetParam=0.0, solver="normal", standardization=False,
                                              regParam=1.0 * ctx["sigma_y"] / max(ctx["n_train"], 1)),
        "lasso": lambda ctx: LinearRegression(elasticNetParam=1.0, regParam=1.0, standardization=False, maxIter=1000),
        "random_forest": lambda ctx: RandomForestRegressor(numTrees=TREES, maxDepth=tree_depth, seed=SEED),
        "gradient_boosting": lambda ctx: GBTRegressor(maxIter=100, maxDepth=3, stepSize=0.1, seed=SEED),
    }
    for k, (_, r) in _optional().items():
        reg[k] = r
    return reg


def available_models(problem_type: str) -> list[str]:
    return list((classification_models() if problem_type == "classification" else regression_models()).keys())
