"""Operators.  Their Python functions are shipped to executors by value, so that a cluster needs no installed copy."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
