"""revmine: review-text analytics as lazy Spark DataFrame operators.

Layout:
  sources/    readers and writers (key-value review blocks, CSV/parquet dims)
  functions/  column expressions (text cleaning, tokenising, arg-max, smoothing)
  operators/  DataFrame -> DataFrame operators (filters, joins, aggregates,
              windows, reshapes, statistics, tf-idf, scoring, topics)
  plans/      named queries over the driver's tables and their SQL oracles
  streaming/  the incremental per-key review statistics
"""

import sys as _sys

try:  # ship our own functions by value so Python workers need no install
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass

__version__ = "0.1.0"
