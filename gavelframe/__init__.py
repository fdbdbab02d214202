"""Property-auction analytics as composable DataFrame -> DataFrame operators on Spark."""

import sys

from pyspark import cloudpickle

# ship the few Python helpers of UDFs with the job, so executors need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
