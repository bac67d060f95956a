"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage.

Functions of this subpackage that run in tasks are shipped to the workers by value,
so that executors need numpy, pyarrow and the named wheels, but no copy of the library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
