"""Log analytics and log-based anomaly detection on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel inside the task, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
