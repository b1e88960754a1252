"""Pairs of constituents inside a jet: neighbours and averaged pair matrices.

Pairs are formed inside the row that holds the jet; rows are never joined with
each other. Cut the constituents to a fixed number first (the cost of a jet
grows with the square of it).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkjets.functions.arrays import explode_items
from sparkjets.functions.numeric import ratio


def nearest_neighbours(points: Column, k: int, coordinates: Sequence[str] = ("eta", "phi")) -> Column:
    """Per point the ``k`` nearest others: ``array<array<struct<distance, j>>>``.

    The nearest entry of each list is taken to be the point itself; equal
    distances are ordered by index.
    """

    def distances(a: Column) -> Column:
        def one(b: Column, j: Column) -> Column:
            square = F.lit(0.0)
            for c in coordinates:
                square = square + (a[c] - b[c]) * (a[c] - b[c])
            return F.struct(F.sqrt(square).alias("distance"), j.alias("j"))

        return F.slice(F.sort_array(F.transform(points, one)), 2, k)

    return F.transform(points, distances)


def edge_features(features: Column, neighbours: Column, names: Sequence[str]) -> Column:
    """Per point and neighbour: the centre's features and neighbour minus centre."""

    def one(near: Column, i: Column) -> Column:
        centre = F.get(features, i)
        return F.transform(
            near,
            lambda n: F.struct(
                n["j"].alias("j"),
                *[centre[f].alias(f"{f}_centre") for f in names],
                *[(F.get(features, n["j"])[f] - centre[f]).alias(f"{f}_diff") for f in names],
            ),
        )

    return F.transform(neighbours, one)


def _cells(df: DataFrame, matrix: str, names: Sequence[str], keep: Sequence[Column]) -> DataFrame:
    rows = explode_items(df, keep, matrix, "_row", "i")
    cells = explode_items(rows, [c for c in rows.columns if c != "_row"], "_row", "_cell", "j")
    return cells.select(*[c for c in cells.columns if c != "_cell"], *[F.col("_cell")[n].alias(n) for n in names])


def mean_pair_matrix(
    df: DataFrame,
    matrix: str,
    names: Sequence[str] = ("delta", "k_t", "z", "m2"),
    weight: str | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Weighted mean of every cell over the jets that have it: ``*by, i, j, <names>``.

    Padding adds zero value and zero weight, so absent cells simply do not
    count. The groups are the cells of one matrix (N x N, times ``by``), summed
    on the map side.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    cells = _cells(df, matrix, names, [*[F.col(b) for b in by], w.alias("_w")])
    return cells.groupBy(*by, "i", "j").agg(
        *[ratio(F.sum(F.col(n) * F.col("_w")), F.sum("_w")).alias(n) for n in names]
    )


def nonzero_range(means: DataFrame, names: Sequence[str]) -> DataFrame:
    """Smallest and largest non-zero cell of every averaged matrix: ``variable, lo, hi``."""
    row = means.agg(
        *[F.min(F.when(F.col(n) != 0, F.col(n))).alias(f"lo_{n}") for n in names],
        *[F.max(F.when(F.col(n) != 0, F.col(n))).alias(f"hi_{n}") for n in names],
    )
    items = [F.struct(F.lit(n).alias("variable"), F.col(f"lo_{n}").alias("lo"), F.col(f"hi_{n}").alias("hi")) for n in names]
    return row.select(F.explode(F.array(*items)).alias("x")).select("x.*")


def mean_nonzero_matrix(df: DataFrame, matrix: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Sum of every cell over the records, divided by how many of them are non-zero."""
    cells = _cells(df, matrix, [name], [F.col(b) for b in by])
    return cells.groupBy(*by, "i", "j").agg(
        ratio(F.sum(name), F.count(F.when(F.col(name) != 0, 1))).alias(f"mean_{name}")
    )
