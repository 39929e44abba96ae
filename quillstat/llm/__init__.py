"""Corpus operators for training-data pipelines (secrets, dedup, mixing, packing, archives, search, filters).

Functions of this package travel to the executors by value, so a cluster needs
no copy of it on its Python path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
