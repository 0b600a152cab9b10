"""Spark-native retrieval, evaluation and training-data jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Task functions travel to the executors by value, so the package has to be installed on
# the driver only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
