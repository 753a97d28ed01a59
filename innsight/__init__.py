"""Table-to-table operators for hospitality review and benchmark analytics on Spark."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code along: nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
