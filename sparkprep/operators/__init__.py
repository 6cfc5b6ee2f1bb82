from .clean import DropColumns, FillNulls, RemoveDuplicates, RemoveNulls, RemoveOutliers, drop_identifier_columns
from .scale import Scaling
from .encode import Encoding
from .bins import Binning
from .create import FeatureCreation
from .select import FeatureSelection

__all__ = ["DropColumns", "FillNulls", "RemoveDuplicates", "RemoveNulls", "RemoveOutliers",
           "drop_identifier_columns", "Scaling", "Encoding", "Binning", "FeatureCreation",
           "FeatureSelection"]
