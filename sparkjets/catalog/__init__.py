"""Queries over the test tables, each beside the SQL that states what it must return."""

from sparkjets.catalog.base import ORACLES, QUERIES

from sparkjets.catalog import (  # noqa: F401  (importing registers the queries)
    aggregations,
    arrays,
    comparisons,
    features,
    metrics,
    projections,
    sampling,
    sources,
)

__all__ = ["QUERIES", "ORACLES"]
