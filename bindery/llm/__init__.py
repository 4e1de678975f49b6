"""Operators of large training-data pipelines: quality, duplicates, mixing, packing, archives, secrets, chats."""

import sys

from pyspark import cloudpickle

# what tasks run travels with them: executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
