"""Ledgerloom: a Spark-native analytics engine for property graphs of filings.

Every operator is a function from DataFrames to a DataFrame; nothing is executed until the caller acts on the result.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
