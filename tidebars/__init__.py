"""Multi-timeframe series analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code, so the package needs to be
# present on the driver only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
