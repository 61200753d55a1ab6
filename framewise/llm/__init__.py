"""Training-data operators: deduplication, archives, mixing, decontamination,
scoring, joins, search and scans over web-scale corpora.

Nothing else in the library imports this subpackage.  Functions that run in
Python workers are shipped by value, so executors need no installed copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
