"""Corpus curation, labelling and evaluation operators as Spark DataFrame plans.

Functions that run on executors are sent by value, so that executors need Python, numpy, pandas and pyarrow alone.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
