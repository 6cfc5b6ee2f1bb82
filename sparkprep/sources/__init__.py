from .readers import detect_format, ingest_to_parquet, json_safe, load_table, with_row_id
from .sinks import export_csv, write_stage, write_verified

__all__ = ["detect_format", "ingest_to_parquet", "json_safe", "load_table", "with_row_id",
           "export_csv", "write_stage", "write_verified"]
