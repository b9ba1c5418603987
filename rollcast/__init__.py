"""Back-testing and comparing forecasts over panel data with Spark.

A panel is a long table ``(unique_id, ds, y[, exogenous...])`` with one row per
``(unique_id, ds)``.  Results are long tables too: the model is a value in the
``model`` column, never part of a table's schema, until a view asks for it.
"""

import sys

from pyspark import cloudpickle

# Executors get the Python helpers with the job and need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
