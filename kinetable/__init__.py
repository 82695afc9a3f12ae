"""Motion-sensor analytics on Spark DataFrames.

The library is a set of functions from DataFrame to DataFrame.  Every one of
them is lazy unless its docstring says that it runs a job (fitting a model,
reading a bounded set of split points).
"""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel with their code, so that workers need
# not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
