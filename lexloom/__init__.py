"""Lexical and text analytics on Spark: sources, operators, functions, plans and streams as DataFrame programs."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code, so a cluster needs no copy of this package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
