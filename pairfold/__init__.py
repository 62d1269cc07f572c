"""pairfold: collection analytics on Spark DataFrames (pair joins, ordered folds, series statistics)."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to the executors by value, so that nothing need be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
