"""Operators that prepare training data for language models: one module per operator.

Nothing else in the library imports this package. `catalog` names its queries.
"""

import sys

from pyspark import cloudpickle

# What runs in Python workers is sent along, so executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
