"""Operators for large training-data pipelines.

Functions that run in Python workers travel by value, so executors need numpy and
pandas but no copy of this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
