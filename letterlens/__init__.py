"""Mail-archive search and analysis as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# The Arrow UDFs live in this package. Pickling them by value lets executors run them without a
# copy of the package on their Python path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
