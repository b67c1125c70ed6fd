"""A Spark-native engine for financial-crime casework and the data preparation around it."""

import sys

from pyspark import cloudpickle

# Functions that run on executors are shipped with the tasks, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
