"""Operators for training data of language models; nothing else in the library imports them."""

from pyspark import cloudpickle

import cellsift

# Python workers of a cluster need not have the package.
cloudpickle.register_pickle_by_value(cellsift)
