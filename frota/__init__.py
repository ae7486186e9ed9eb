"""Delivery-fleet analytics as Spark DataFrame, SQL and Structured Streaming jobs."""

import sys

from pyspark import cloudpickle

# functions sent to tasks travel whole, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
