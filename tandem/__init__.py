"""Prepare, enrich and score text-rewriting corpora with Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: task functions travel whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
