"""Spatio-temporal clustering and run analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Arrow functions defined here are shipped to the executors with the job, so a
# cluster needs no separate installation of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
