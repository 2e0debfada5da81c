"""visitframe: longitudinal event records as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel with their code, so executors need
# no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
