"""Training-data operators. Nothing outside this package and ``corpus_pipeline`` imports it.

Functions that run inside tasks travel with their code, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
