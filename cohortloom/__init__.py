"""cohortloom: consensus clustering and cohort profiling of binary traits on Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Ship the functions used inside tasks with the tasks, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
