"""Defect analytics on Spark: ingest, clean, chunk, embed, parse, search, evaluate."""

import sys

from pyspark import cloudpickle

# Functions that run inside Python workers travel with the job, so that executors need no
# copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
