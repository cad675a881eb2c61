"""sonolake: a Spark-native engine for ordered, partitioned signal analytics.

Queries are declared with DataFrames and SQL; numpy kernels run inside Arrow
functions only where a computation is sequential or dense.  Functions of this
package travel to executors by value, so a cluster needs no copy of it on disk.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
