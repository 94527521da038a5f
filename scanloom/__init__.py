"""Security analytics over many source-code repositories as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Ship the few Python helpers by value, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
