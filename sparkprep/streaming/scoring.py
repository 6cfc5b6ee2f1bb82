"""Replay fitted row-wise steps (missing-marker rule, scaling, encoding,
binning, polynomial/datetime parts, fitted model scoring) on a streaming
DataFrame. Steps that need the whole table at transform time (keep-first
de-duplication, group aggregates) are rejected: they are not row-wise."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.missing import standardize_missing
from ..plans.base import FittedStep

NOT_ROW_WISE = {"remove_duplicates"}


def replay_stream(stream: DataFrame, steps: list[FittedStep]) -> DataFrame:
    cur = standardize_missing(stream)
    for s in steps:
        if s.kind in NOT_ROW_WISE or (s.kind == "feature_creation" and s.params.get("method") == "aggregations"):
            raise ValueError(f"step '{s.kind}' is not row-wise and cannot score a stream")
        cur = s.transform(cur)
    return cur


def start_scoring(stream: DataFrame, steps: list[FittedStep], sink_path: str, checkpoint_location: str,
                  trigger_once: bool = False):
    """Append the transformed stream to Parquet; progress is kept in ``checkpoint_location``
    (a shared folder), so a restarted query resumes exactly once."""
    w = (replay_stream(stream, steps).writeStream.format("parquet").option("path", sink_path)
         .option("checkpointLocation", checkpoint_location).outputMode("append"))
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
