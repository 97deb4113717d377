"""labelmill: PySpark operators for multi-label classification of text and source code.

Everything is a pure ``DataFrame -> DataFrame`` function built on the DataFrame, SQL and
Spark ML APIs.  Python runs inside tasks only where a row has to be parsed by the Python
or HTML grammar.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# UDFs carry the package's own helpers with them, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
