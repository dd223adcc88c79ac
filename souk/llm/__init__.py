"""Operators of a training-data pipeline; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Tasks get these functions with the job, so workers need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
