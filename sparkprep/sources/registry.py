"""The model-result registry is a directory of ``*_results.json`` documents,
read as one table (one row per trained model)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the list shows of a document; ``score`` and ``metrics`` are the best model's.
LISTED = ("model_id string, problem_type string, target_column string, best_model string, created_at string, "
          "filename string, score double, metrics map<string,double>, dataset_info struct<rows:long,train_rows:long,test_rows:long,features:long>")


def list_models(spark: SparkSession, results_dir: str) -> DataFrame:
    df = spark.read.schema(LISTED).json(f"{results_dir.rstrip('/')}/*/*_results.json")
    return df.withColumn("file", F.col("_metadata.file_name"))
