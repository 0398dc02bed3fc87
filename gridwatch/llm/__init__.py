"""Operators of a training-data pipeline, each a Spark job over document tables.

Nothing else in the library imports this package.  Functions that run inside
tasks are shipped to the executors by value, so the executors need PySpark and
the public libraries only.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
