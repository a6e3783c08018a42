"""Short-text clustering on Spark: literal (n-gram MinHash) and semantic (vector density) views."""

import sys

from pyspark import cloudpickle

# Kernels travel with their code, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
