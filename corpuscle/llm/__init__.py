"""Operators for large-scale training-data pipelines.

Nothing else in the package imports this subpackage; its queries live in
``corpuscle.llm.queries``.  Functions of this package are shipped to executors
by value, so that a cluster needs no installed copy.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
