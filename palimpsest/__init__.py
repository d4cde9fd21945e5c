"""PySpark-native engine for agent-memory data: logs, lifecycles, vectors, graphs and text."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions sent to Python workers carry their code along, so executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
