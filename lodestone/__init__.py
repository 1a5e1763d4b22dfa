"""A Spark-native engine for document analytics."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their tasks, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
