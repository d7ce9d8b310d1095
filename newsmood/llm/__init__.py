"""Operators for preparing training data. Nothing else in the package imports this one."""

import sys

from pyspark import cloudpickle

# Executors get the code of the tasks with the tasks and need no install of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
