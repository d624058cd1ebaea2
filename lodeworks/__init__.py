"""A PySpark library for evidence-based snapshots of files, documents, pages and event logs."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel by value, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
