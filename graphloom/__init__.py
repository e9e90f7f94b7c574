"""Code knowledge graphs as DataFrames: ingest, resolve, search, traverse, rank, keep fresh."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so a cluster needs no copy of it on each machine.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
