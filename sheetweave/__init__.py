"""Spark-native digitization of piping-and-instrumentation drawings.

Tables of detected symbols, recognised text and candidate line segments go in;
cleaned tables and a graph of symbols and links come out. Every operator is a
function from DataFrames to a DataFrame, keyed by ``drawing_id``.
"""

import sys

from pyspark import cloudpickle

# Executors get the helper functions with the job and need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
