"""A PySpark-native engine for labelling point clouds and preparing large corpora."""

import sys

from pyspark import cloudpickle

# Executors need not have this package: its functions go to them by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
