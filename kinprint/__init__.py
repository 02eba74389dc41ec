"""kinprint: a Spark-first engine for code similarity scans and near-duplicate analytics."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Arrow functions travel to the workers by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
