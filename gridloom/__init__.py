"""Spark-native analytics for voxel grids, climate rasters and tilt series.

The package is split by role:

``functions``  column expressions (index algebra, slab rules, scalar rules)
``operators``  DataFrame -> DataFrame operators (grid, placement, bricks, raster, tomography)
``sources``    scans, fixtures built from the given tables, writers
``streaming``  Structured Streaming statistics
``plans``      every registered query next to the SQL text that checks it
"""

import sys

from pyspark import cloudpickle

# Kernels travel to the Python workers as code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
