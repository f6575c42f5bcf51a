"""Operators for preparing training data, their registered queries and the SQL that checks them."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
