"""domquarry: template-driven page extraction on Spark.

Functions of this package that run inside Spark tasks (the tokeniser of
``mapInArrow``, the streaming state function) are pickled *by value*, so
executors need neither this package installed nor the driver's working
directory on their path.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
