"""Binnings and bin lookup.

A bin lookup is an expression on literal edges, never a range join. Uniform
edges cost one division; other edges a balanced ``CASE`` tree (log2 n compares).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A CASE tree larger than this no longer compiles to one small method.
_TREE_LIMIT = 128


@dataclass(frozen=True)
class Binning:
    """Edges over one variable: linear, logarithmic (``log_base``) or explicit."""

    variable: str
    bins: int | Sequence[float]
    min_bin: float | None = None
    max_bin: float | None = None
    log_base: float | None = None
    edges: tuple[float, ...] = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        if isinstance(self.bins, int):
            if self.min_bin is None or self.max_bin is None:
                raise ValueError("a bin count needs min_bin and max_bin")
            if self.log_base:
                exponents = np.linspace(
                    math.log(self.min_bin, self.log_base), math.log(self.max_bin, self.log_base), self.bins + 1
                )
                edges = np.power(float(self.log_base), exponents)
            else:
                edges = np.linspace(self.min_bin, self.max_bin, self.bins + 1)
        else:
            edges = np.asarray(self.bins, dtype=float)
        if len(edges) < 2 or np.any(np.diff(edges) <= 0):
            raise ValueError("bin edges must increase")
        object.__setattr__(self, "edges", tuple(float(e) for e in edges))

    @property
    def n_bins(self) -> int:
        return len(self.edges) - 1

    @property
    def is_uniform(self) -> bool:
        return isinstance(self.bins, int) and not self.log_base

    @property
    def mids(self) -> list[float]:
        return [(a + b) / 2 for a, b in zip(self.edges, self.edges[1:])]

    @property
    def widths(self) -> list[float]:
        return [b - a for a, b in zip(self.edges, self.edges[1:])]

    @property
    def labels(self) -> list[str]:
        return [f"({a}, {b}]" for a, b in zip(self.edges, self.edges[1:])]

    def same_as(self, other: "Binning") -> bool:
        return (
            self.variable == other.variable
            and len(self.edges) == len(other.edges)
            and bool(np.allclose(self.edges, other.edges))
        )

    def table(self, spark: SparkSession) -> DataFrame:
        """The bin dimension: ``bin, bin_lo, bin_hi, bin_mid, bin_width, bin_label``."""
        rows = [
            (i, a, b, m, w, label)
            for i, (a, b, m, w, label) in enumerate(
                zip(self.edges, self.edges[1:], self.mids, self.widths, self.labels)
            )
        ]
        schema = "bin int, bin_lo double, bin_hi double, bin_mid double, bin_width double, bin_label string"
        return spark.createDataFrame(rows, schema)


def _edges_passed(x: Column, edges: Sequence[float], inclusive: bool) -> Column:
    """How many edges lie at or below ``x`` (``inclusive``), or strictly below it."""

    def passed(edge: float) -> Column:
        return x >= F.lit(edge) if inclusive else x > F.lit(edge)

    def search(low: int, high: int) -> Column:
        # invariant: edges[:low] are passed, edges[high:] are not
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(passed(edges[middle]), search(middle + 1, high)).otherwise(search(low, middle))

    if len(edges) <= _TREE_LIMIT:
        return search(0, len(edges))
    literal = F.array(*[F.lit(float(e)) for e in edges])
    return F.size(F.filter(literal, (lambda e: e <= x) if inclusive else (lambda e: e < x)))


def grid_points_below(
    x: Column, start: float, stop: float, intervals: int, inclusive: bool = False, divided: bool = False
) -> Column:
    """How many points of an even grid of ``intervals + 1`` points lie below ``x``.

    One division finds the neighbourhood and two compares against the exact
    grid points remove its rounding error. Point i is start + i * step, or with
    ``divided`` start + i * (stop - start) / intervals.
    """
    step = (stop - start) / intervals
    guess = F.ceil((x - F.lit(float(start))) / F.lit(step))
    guess = F.least(F.greatest(guess, F.lit(0)), F.lit(intervals + 1)).cast("int")

    def point(i: Column) -> Column:
        i = i.cast("double")
        offset = i * F.lit(float(stop - start)) / F.lit(float(intervals)) if divided else i * F.lit(step)
        inner = F.lit(float(start)) + offset
        return F.when(i >= float(intervals), F.lit(float(stop))).otherwise(inner)

    def is_below(i: Column) -> Column:
        return point(i) <= x if inclusive else point(i) < x

    return (
        F.when((guess > 0) & ~is_below(guess - 1), guess - 1)
        .when((guess <= intervals) & is_below(guess), guess + 1)
        .otherwise(guess)
    )


def _edges_below(x: Column, binning: Binning, inclusive: bool) -> Column:
    if binning.is_uniform and binning.n_bins > 8:
        return grid_points_below(x, binning.edges[0], binning.edges[-1], binning.n_bins, inclusive)
    return _edges_passed(x, binning.edges, inclusive)


def bin_clamped(x: Column, binning: Binning) -> Column:
    """Left-closed bin index; values outside fall into the first or last bin, NULL and NaN into none."""
    index = _edges_below(x, binning, inclusive=True) - 1
    inside = F.least(F.greatest(index, F.lit(0)), F.lit(binning.n_bins - 1)).cast("int")
    return F.when(x.isNotNull() & ~F.isnan(x.cast("double")), inside)


def bin_right_closed(x: Column, binning: Binning) -> Column:
    """Bin index of ``(lo, hi]``; NULL for values outside, NaN included."""
    inside = (x > F.lit(binning.edges[0])) & (x <= F.lit(binning.edges[-1]))
    return F.when(inside, (_edges_below(x, binning, inclusive=False) - 1).cast("int"))


def bin_with_class(index: Column, n_bins: int, label: Column, class_1, class_2, drop_unmatched: bool = False) -> Column:
    """Bins of the second class follow those of the first; a row of neither class goes to bin 0."""
    unmatched = F.lit(None) if drop_unmatched else F.lit(0)
    return (
        F.when(label.isin(list(class_1)), index)
        .when(label.isin(list(class_2)), index + n_bins)
        .otherwise(unmatched)
        .cast("int")
    )


def bin_joint(first: Column, second: Column, n_second: int) -> Column:
    """Row-major index of a pair of bins."""
    return (first * n_second + second).cast("int")


def class_split(label: Column, class_1, class_2) -> Column:
    """1 for the first class; 0 for the second class and for everything else."""
    return F.when(label.isin(list(class_1)), 1).when(label.isin(list(class_2)), 0).otherwise(0)
