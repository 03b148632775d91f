"""Operators of a training-data pipeline; nothing else in the package imports this folder."""

import sys

from pyspark import cloudpickle

# The functions that tasks run travel with the job, so executors need not have this folder.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
