"""File-inventory analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Ship the package's own functions with each UDF, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
