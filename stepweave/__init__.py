"""stepweave: SQL-step lineage, certified metric knowledge and corpus operators as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
