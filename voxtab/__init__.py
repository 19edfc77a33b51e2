"""voxtab: speech-transcription job data as Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python functions travel to the executors as code, so that the package need not be
# installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
