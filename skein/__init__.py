"""skein: article analytics on Spark DataFrames.

Sub-packages: ``functions`` (column expressions), ``sources`` (readers and
writers), ``operators`` (DataFrame to DataFrame), ``plans`` (whole pipelines and
the registered queries), ``streaming``.
"""

import sys

from pyspark import cloudpickle

# Workers get the functions themselves, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
