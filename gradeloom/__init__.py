"""gradeloom: code-quality analytics over large corpora of source files, as Spark jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run in Python workers are sent by value, so executors need no
# copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
