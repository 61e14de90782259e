"""Contextual-bandit data on Spark: interactions, policies, off-policy evaluation and comparison of results."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
