"""vectab: tables of documents and their vector embeddings, worked on as Spark jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run in Python workers travel with their code, so executors
# need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
