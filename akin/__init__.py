"""Content-based similarity search over text collections, as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from akin.config import SearchConfig

__all__ = ["SearchConfig"]

# Functions that run in tasks travel with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
