"""Training-data operators: cleaning, deduplication, decontamination, mixing and sharding of a corpus."""

import sys

from pyspark import cloudpickle

# functions of this subpackage travel to the executors by value, so a cluster needs no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
