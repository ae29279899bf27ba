"""Reliability analytics for generated text, as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# functions sent to Python workers travel whole, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
