"""Batch operators and reports for a small manufacturer's books, on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Fold steps travel to the executors by value, so these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
