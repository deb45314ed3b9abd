"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage.  Its functions are
shipped to executors by value, so a cluster needs no copy of the package.
"""

from pyspark import cloudpickle as _cloudpickle

import sys as _sys

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
