"""Operators that prepare documents and conversations for language-model training.

Functions of this package travel to the executors by value, so these need Python and its
libraries only, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
