"""Operators for preparing training data, and the queries that apply them to the given tables."""

import sys

from pyspark import cloudpickle

# tasks get these functions by value, so that executors need no copy of the package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
