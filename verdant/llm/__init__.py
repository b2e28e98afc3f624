"""Training-data operators: deduplication, filtering, scoring, mixing and sharding of text corpora."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so the cluster needs no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
