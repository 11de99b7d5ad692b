"""Statistics and clustering operators for wide panel tables, on Spark."""

import sys

from pyspark import cloudpickle

# functions run inside tasks travel with the job, so executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
