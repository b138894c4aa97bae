"""Streaming operators. Stateful processors are sent to the workers whole, which need no copy of this code."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
