"""chronolith: log-prefix analytics, temporal graphs, retrieval and streaming detection on PySpark."""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions sent to workers travel by value: a worker needs no copy of the package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
