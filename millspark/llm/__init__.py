"""Corpus operators for training data: scoring, personal data, archives, deduplication, decontamination, mixing and search."""

import sys

from pyspark import cloudpickle

# Executors get the functions of this package with each job; they need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
