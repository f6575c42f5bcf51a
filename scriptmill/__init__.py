"""Narration-script preparation on Spark: text cleaning, segmentation, casting and planning."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so that executors need not have
# this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
