"""memlake: long-lived text memory as Spark tables and streams."""

import sys

from pyspark import cloudpickle

# Functions of this package that run inside Python workers travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
