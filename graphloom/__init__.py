"""graphloom: multimodal graph retrieval and text-corpus operators on Spark.

Python kernels of this package are pickled by value, so executors run them
without the package being installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
