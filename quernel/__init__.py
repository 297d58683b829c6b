"""quernel: knowledge-graph analytics and table repair on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions for Python workers travel whole, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
