"""threadscope: discussion analytics as Spark DataFrame jobs.

Posts and comments are long tables; every operator is a function from
DataFrames/Columns to DataFrames/Columns and leaves physical planning to
Catalyst and AQE.
"""

import sys as _sys

__version__ = "0.1.0"

# Python-side helpers (pandas UDF bodies) are shipped with the task by value,
# so executors do not need this package on their import path.
try:
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass
