"""Operators for large text corpora. Nothing else in the library imports this subpackage.

Functions that run in Python workers are sent to them whole, so that a cluster's machines need no copy of this code.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
