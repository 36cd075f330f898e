"""Timberline: decision-tree and forest analytics as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so a job needs no
# copy of the package on the worker machines.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
