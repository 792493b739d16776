"""Data side of model evaluation and fine-tuning, as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Python workers get this package's functions with the task, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
