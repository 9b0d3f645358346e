"""Spark-native preparation, analysis, splitting, scoring and evaluation of
labelled text, multi-label, vector and image tables."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code, so the executors need
# no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
