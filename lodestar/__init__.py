"""Lodestar: text retrieval, ranking and corpus analytics as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# functions of this package travel to the executors by value: they need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
