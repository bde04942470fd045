"""Operators of a training-data pipeline over the ``documents`` table.

One module per operator; ``queries`` registers them. Functions of this
package are shipped to executors by value, so that Python workers need no
copy of the package on their path.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
