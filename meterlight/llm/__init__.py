"""Corpus operators for preparing language-model training data.

Functions handed to Python workers are pickled by value, so executors need no
copy of this repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
