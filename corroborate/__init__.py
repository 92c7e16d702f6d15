"""Cross-document evidence reconciliation and corpus preparation on PySpark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with the job, so workers need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
