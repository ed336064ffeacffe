"""docustrata: a PySpark-native engine for corpora of versioned, tree-structured documents."""

import sys

from pyspark import cloudpickle

# functions of this package travel with the job, so executors need not have it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
