"""Operators for preparing text corpora; nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package
