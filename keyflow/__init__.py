"""Elastic keyed-state analytics on PySpark."""

import sys

from pyspark import cloudpickle

# Python workers get this package's functions with the plan; executors need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
