"""Operational event analytics on Spark: usage, captures, messages, ledgers, jobs and scores."""

import sys

from pyspark import cloudpickle

# Python helpers travel with the tasks, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
