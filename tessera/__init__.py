"""Analytics on gridded measurements, and training-data operators, as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel whole, so that a cluster needs no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
