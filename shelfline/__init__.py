"""Catalogue analytics as Spark DataFrame jobs: feeds in, one wide product table out."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so workers need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
