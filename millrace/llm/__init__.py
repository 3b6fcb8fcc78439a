"""Operators for large text corpora. Nothing outside this subpackage imports it.

Functions sent to Python workers travel by value, so that executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
