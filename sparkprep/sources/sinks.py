"""Stage writers with row-count verification and CSV export."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW_ID = "_orig_idx"


def stage_name(source: str, stage: str) -> str:
    base = os.path.splitext(os.path.basename(source.rstrip("/")))[0]
    prefix = {"cleaned": "cleaned_", "engineered": "feature_engineered_"}[stage]
    return f"{prefix}{base}.parquet"


def write_verified(df: DataFrame, path: str) -> dict:
    """Write Parquet, count the written table (footers only) and the
    source, and raise if they differ. No ``Observation`` here: in Spark 4.1 a session that
    has used one can no longer serialize fitted models that keep a training
    summary (logistic regression), which breaks later scoring jobs."""
    df.write.mode("overwrite").parquet(path)
    rows, source = df.sparkSession.read.parquet(path).count(), df.count()
    if rows != source:
        raise OSError(f"{path} holds {rows} rows, the source has {source}")
    return {"path": path, "rows": rows}


def write_stage(df: DataFrame, base_dir: str, source: str, stage: str) -> dict:
    return write_verified(df, os.path.join(base_dir, stage_name(source, stage)))


def export_csv(df: DataFrame, path: str) -> str:
    """CSV with header, internal row id dropped."""
    out = df.drop(ROW_ID) if ROW_ID in df.columns else df
    out.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_json_arrays(df: DataFrame, path: str) -> str:
    """Write every partition as one JSON array of records (the layout a
    ``multiLine`` JSON reader expects), without gathering rows anywhere."""
    import pandas as pd

    lines = df.select(F.to_json(F.struct(*df.columns)).alias("j"))

    def wrap(batches):
        first = True
        for pdf in batches:
            if pdf.empty:
                continue
            body = pdf["j"].tolist()
            out = [("[" if first else ",") + body[0]] + ["," + x for x in body[1:]]
            first = False
            yield pd.DataFrame({"value": out})
        if not first:
            yield pd.DataFrame({"value": ["]"]})

    lines.mapInPandas(wrap, "value string").write.mode("overwrite").text(path)
    return path
