"""Operators on tables; their code goes to the workers by value, as these may lack the library."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
