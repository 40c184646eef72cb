"""Operators of a training-data pipeline; nothing else in the library imports this package.

Functions that run in Python workers are shipped by value, so executors need no copy of the
package and the working folder does not matter.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
