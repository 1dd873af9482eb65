"""Training-data operators: filters, duplicates, mixing, packing and search over document tables.

Modules are shipped to Python workers by value, so workers need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
