"""lipika: a PySpark-native engine for multilingual transcript corpora."""

import sys

from pyspark import cloudpickle

# Python functions travel to executors by value, so the package needs no installation there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
