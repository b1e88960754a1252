"""Particle-jet analytics on Spark DataFrames.

Every operator is a plain function ``fn(df, ...) -> DataFrame`` (use it with
``df.transform``) and every scalar function is ``fn(column, ...) -> Column``.
:class:`JetDataset` wraps a DataFrame with its target, weight and metadata for
callers that prefer a fluent API.
"""

import sys

from pyspark import cloudpickle

from sparkjets.dataset import JetDataset

# The few functions that run in Python workers travel with the job, so the
# executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["JetDataset"]
