"""sensorframe: a Spark-first engine for wearable-sensor data points, labelled intervals and packets."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to Python workers by value, so executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
