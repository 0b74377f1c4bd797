"""Analytics over identifying vectors, expressed as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

from vidspark.session import build_session

# task code travels with the task: executors need numpy, pandas and pyarrow, not this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session"]
