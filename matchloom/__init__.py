"""Set-level document/vacancy matching, scoring and bookkeeping operators on Spark."""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so a job needs no copy of the package on every node.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
