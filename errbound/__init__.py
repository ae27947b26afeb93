"""Error-bounded numeric data processing on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from errbound.config import Algorithm, Config, ErrorBoundMode, Interpolator

# Ship the package's functions inside the UDFs, so executors need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Algorithm", "Config", "ErrorBoundMode", "Interpolator"]
