"""Document extraction and training-data preparation on Spark.

Functions that run in tasks are shipped by value, so a cluster's executors need
no copy of the package.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
