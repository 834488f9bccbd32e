"""Operators for preparing language-model training data.

Each module is one operator; ``queries`` registers them on the supplied tables.
Nothing outside this folder imports it.
"""

import sys

from pyspark import cloudpickle

# functions of this folder travel to Python tasks by value: workers need no copy of the library
cloudpickle.register_pickle_by_value(sys.modules[__name__])
