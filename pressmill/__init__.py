"""News curation and digest analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# The few vectorised helpers travel inside the tasks, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
