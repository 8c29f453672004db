"""hyplab: score, fuse, gate and promote text hypotheses with Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Kernels travel with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
