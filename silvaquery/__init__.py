"""Spark-native analytics over forest point clouds and per-tree tables."""

import sys

from pyspark import cloudpickle

# Executors get functions by value, so a cluster needs no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
