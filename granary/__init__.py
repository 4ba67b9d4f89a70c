"""Stock analytics on Spark: DataFrame operators over items, ledgers and catalogs."""

import sys

from pyspark import cloudpickle

# the few functions that run in Python workers travel with their code, so executors need no
# installed copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
