"""Spark-native analytics for sparse, block-structured, multi-level 3-D grids.

Cells, blocks, points, samples and series are plain DataFrames.  Addressing is
a projection, neighbourhoods are equi-joins or border exchanges keyed by block,
reductions are partial aggregations, and only dense per-block arithmetic runs
as Arrow-batched numpy.
"""

import sys

from pyspark import cloudpickle

from lattica.schema import Grid

# Batch functions travel to executors by value, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Grid"]
