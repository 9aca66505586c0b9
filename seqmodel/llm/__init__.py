"""Operators for preparing language-model training data; nothing else in the library imports this package.

Tasks carry the functions of this package with them, so executors need not have it installed.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
