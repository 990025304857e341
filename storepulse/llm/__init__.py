"""Training-data operators: ten operators over documents, pages and embeddings, each in a module of its own.

Nothing else in the library imports this subpackage. Its Python task functions travel to the
executors by value, so the workers need no copy of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
