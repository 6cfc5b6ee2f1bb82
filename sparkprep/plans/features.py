"""ordered feature steps with an optional ``upto_step`` prefix.

Load -> C1 -> drop identifier columns -> each step fitted on the previous
step's output. Returns the fitted steps (replayable on new data), the output,
per-step details and the column-set diff (D5).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..functions.missing import standardize_missing
from ..operators import Binning, Encoding, FeatureCreation, FeatureSelection, Scaling, drop_identifier_columns
from ..operators.diff import column_summary
from .base import FittedStep

STEP_TYPES = {"scaling": Scaling, "encoding": Encoding, "binning": Binning,
              "feature_creation": FeatureCreation, "feature_selection": FeatureSelection}


@dataclass
class FeatureSpec:
    steps: list = field(default_factory=list)

    @staticmethod
    def from_dicts(items: list[dict]) -> "FeatureSpec":
        steps = []
        for d in items:
            d = dict(d)
            kind = d.pop("type")
            if kind not in STEP_TYPES:
                raise ValueError(f"unknown step type: {kind}")
            steps.append(STEP_TYPES[kind](**d))
        return FeatureSpec(steps)


@dataclass
class FeatureResult:
    steps: list[FittedStep]
    output: DataFrame
    summaries: list[dict]
    columns: dict


def run_features(df: DataFrame, spec: FeatureSpec, upto_step: int | None = None,
                 drop_ids: bool = True) -> FeatureResult:
    base = standardize_missing(df)
    if drop_ids:
        base = drop_identifier_columns(base)
    cur, fitted, summaries = base, [], []
    steps = spec.steps if upto_step is None else spec.steps[: upto_step + 1]
    for step in steps:
        f = step.fit(cur)
        cur = f.transform(cur)
        fitted.append(f)
        summaries.append(f.meta)
    return FeatureResult(fitted, cur, summaries, column_summary(base.columns, cur.columns))


def replay(df: DataFrame, steps: list[FittedStep], drop_ids: bool = True) -> DataFrame:
    """Score new data with exactly the fitted steps (no refit)."""
    cur = standardize_missing(df)
    if drop_ids:
        cur = drop_identifier_columns(cur)
    for s in steps:
        cur = s.transform(cur)
    return cur
