"""Table cleaning and classical statistics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Executors receive the few Python helpers with the job; the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
