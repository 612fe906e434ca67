"""Kinloom: entity resolution and unified profiles as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel whole, so that no worker needs this package
# installed or on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
