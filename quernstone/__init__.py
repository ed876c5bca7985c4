"""Spark-native analytics for corpora of compiled functions and similar text."""

import sys

from pyspark import cloudpickle

# Functions that Spark ships to Python workers travel by value, so that the
# workers need no copy of this package on their own import path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
