"""varscope: column profiling, filtering, chart data and data-quality checks as Spark jobs."""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions that run inside tasks are shipped by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
