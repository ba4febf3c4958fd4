"""Spark-native analytics for sensor time series."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel with their code, so that workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
