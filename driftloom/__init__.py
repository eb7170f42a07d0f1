"""Driftloom: drift analytics over source trees, contracts and snapshots, on PySpark."""

import sys

from pyspark import cloudpickle

# Executors needn't have this package installed: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
