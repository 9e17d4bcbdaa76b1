"""strideflow - analytics over athlete motion sequences, written for Spark.

Every public operator takes DataFrames and returns a DataFrame; nothing here
collects rows to the driver.  See ``README.md`` for the map of modules.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Ship the small Python kernels inside the tasks, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
