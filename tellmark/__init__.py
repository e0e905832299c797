"""tellmark: Spark operators for building, checking and modelling labelled text corpora."""

import sys

from pyspark import cloudpickle

# Python workers get the library's few functions inside the task, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
