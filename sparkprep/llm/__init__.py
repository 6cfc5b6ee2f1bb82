"""Operators for preparing large text corpora (filters, dedup, scoring, mixing).

Nothing else in the library imports this subpackage. Kernels that run in Python
workers are shipped by value, so workers need no copy of the package.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
