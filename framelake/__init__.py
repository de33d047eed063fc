"""Spark-native analytics for large collections of small images.

Operators are plain functions from DataFrame to DataFrame that take their column names as
arguments. Nothing here creates a session, reads the clock or prints.
"""

import sys

from pyspark import cloudpickle

# Ship the task functions of this package by value, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
