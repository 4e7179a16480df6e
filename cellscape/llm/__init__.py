"""Operators for preparing training data; nothing outside this package needs it."""

import pickle
import sys

from pyspark import cloudpickle

# Executors need no copy of the package: its functions travel with the tasks ...
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# ... and its objects as bytes that hold their classes, which a plain broadcast would look up by name.
def shipped(spark, value):
    """A broadcast of the package's own objects, to be opened by `opened`."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def opened(broadcast):
    return pickle.loads(broadcast.value)
