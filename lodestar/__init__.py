"""lodestar: code-intelligence and corpus analytics as lazy Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors need not have the package installed: functions travel with their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
