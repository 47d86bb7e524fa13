"""Reconciliation of two snapshots of a data set, expressed as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# what runs inside tasks travels with the job, so executors need no copy of the library
cloudpickle.register_pickle_by_value(sys.modules[__name__])
