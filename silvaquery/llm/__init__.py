"""Training-data operators: one module per operator, queries in ``queries``."""

import sys

from pyspark import cloudpickle

# Executors get these functions by value, so a cluster needs no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
