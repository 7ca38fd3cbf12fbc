"""gridmark: labelled-raster and evaluation-table analytics as Spark DataFrame operators.

Rasters are long tables with one row per pixel, keyed by the image key columns plus
``(y, x)``.  Every pixel row carries its image's ``height`` and ``width`` so bounds checks
stay row-local and never need a join.  Masks are sparse: only foreground pixels are rows.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value: workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
