"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage; ``__spark_entry__.py``
adds its queries (``civicframe.llm.queries``) when it can be imported.
"""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the workers by value, so a cluster
# needs no copy of it on the workers' path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
