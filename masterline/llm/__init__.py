"""Operators for training-data pipelines, each a function from DataFrames to a DataFrame."""

import sys

from pyspark import cloudpickle

# What runs in tasks is sent with them: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
