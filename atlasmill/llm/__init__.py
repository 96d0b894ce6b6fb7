"""Operators for training-data pipelines: counting, scoring, de-duplicating, mixing and sharding texts."""

import sys

from pyspark import cloudpickle

# Workers get the functions themselves, so they need not be able to import this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
