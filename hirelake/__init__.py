"""Job-postings analytics and corpus preparation as Spark DataFrame operators."""

from pyspark import cloudpickle as _cloudpickle
import sys as _sys

# Functions that run in Python workers travel by value, so executors need no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
