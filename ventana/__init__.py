"""ventana: time-series table operators for PySpark.

Subpackages: ``functions`` (column expressions), ``sources`` (scans, stores,
sinks), ``operators`` (aggregations, windows, joins, learning), ``streaming``
(Structured Streaming ingest) and ``plans`` (registered queries + oracles).
"""

import sys as _sys

__version__ = "0.1.0"

# The few Python UDFs (isolation forest) are defined in this package; pickling
# the package by value ships their code with each task, so executors need no
# installed copy of it.
try:
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older pyspark: fall back to --py-files / installed package
    pass
