"""Operators for training-data pipelines: deduplication, scoring, packing, media.

Nothing else in the library imports this package. Its functions are shipped to
executors by value, so the package need only be importable on the driver.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
