"""A PySpark-native knowledge-graph and retrieval analytics engine."""

import sys

from pyspark import cloudpickle

# functions that run on executors travel by value, so that executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
