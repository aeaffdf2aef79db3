"""Training-data operators: mixing, licence scans, quality rules, deduplication,
language identification, language-model scoring and packing."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code along, so that workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
