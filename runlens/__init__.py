"""runlens: experiment-log analytics as plain Spark DataFrames.

Importing the package registers it with PySpark's cloudpickle by value, so
functions that run inside Python workers travel with the job and executors need
no installed copy of the library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
