"""Deterministic price-structure analytics on Spark."""

import sys

from pyspark import cloudpickle

# Executors need no installed copy: functions of this package travel with the tasks that use them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
