"""Pixel-corpus and asset-lineage analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Workers get this package's functions themselves, so they need not be able to import it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
