"""Workload energy analytics on Spark: specs to features, counters to labels, KNN to predictions."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to Python workers by value, so that executors need
# no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
