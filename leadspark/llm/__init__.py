"""Operators of a training-data pipeline over tables of documents and pages."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the plan; broadcast values are plain (see scratch.kept), so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
