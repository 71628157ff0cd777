"""Player-value analytics on Spark.

Functions that run inside Spark tasks are pickled by value, so executors need
numpy and pandas but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
