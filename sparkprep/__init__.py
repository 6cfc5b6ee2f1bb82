"""sparkprep: data preparation, feature engineering and model building as lazy Spark plans."""

from .session import get_spark

__version__ = "0.1.0"
__all__ = ["get_spark"]
