"""Operators of a training-data pipeline: search, filters, deduplication, formatting, tokens.

Each module holds one operator with a general interface; ``queries`` registers one query each.
Functions that run in tasks travel by value, so executors need not have this package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
