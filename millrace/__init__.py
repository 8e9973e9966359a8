"""Schema-governed event streams on Spark DataFrames and Structured Streaming."""

import sys

from pyspark import cloudpickle

# Executors need not have this package: the few Python functions that run there travel with their tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
