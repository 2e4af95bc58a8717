"""Credit-risk analytics as Spark DataFrame operators.

Every operator takes DataFrames keyed by an id column and returns DataFrames;
small fitted state (means, cut-offs, bucket bounds) is the only thing that
reaches the driver.
"""

import sys

from pyspark import cloudpickle

# The few batch functions travel to the executors with the tasks, so the package
# has to be installed on the driver only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
