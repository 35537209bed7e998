"""Link table cells to knowledge-base entities, and score such links, on Spark."""

import sys

from pyspark import cloudpickle

from tablelink.config import LinkConfig

# Functions that run in Python workers travel with the job, so the package need
# not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["LinkConfig"]
