"""Text search, point access and text processing as PySpark DataFrame operations."""

import sys

from pyspark import cloudpickle

# Workers get the package's functions by value: a job needs no installation on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
