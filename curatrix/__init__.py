"""Item-catalogue integration and batch hybrid retrieval on Spark DataFrames.

Every public function takes and returns DataFrames or Columns; nothing here
owns a session, a server or a storage engine.
"""

import sys

from pyspark import cloudpickle

# Functions run inside tasks travel by value, so executors need no copy of
# this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
