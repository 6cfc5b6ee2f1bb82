from .missing import standardize_missing, is_missing_text
from .quantiles import exact_quantiles, median
from .rank import dense_codes, with_global_index, with_running_total
from .stats import bias_corrected_skew, pairwise_corr
from .types import is_numeric, is_numeric_or_bool, is_text, is_datetime, numeric_columns, text_columns

__all__ = ["standardize_missing", "is_missing_text", "exact_quantiles", "median", "dense_codes",
           "with_global_index", "with_running_total", "bias_corrected_skew", "pairwise_corr",
           "is_numeric", "is_numeric_or_bool", "is_text", "is_datetime", "numeric_columns",
           "text_columns"]
