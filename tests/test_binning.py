import bisect
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkjets.functions.binning import Binning, bin_clamped, bin_right_closed, grid_points_below

EXPLICIT = Binning("x", [0.0, 1.0, 2.5, 7.0, 10.0])
CASES = [
    EXPLICIT,
    Binning("x", 5, 0.0, 10.0),
    Binning("x", 50, 0.0, 10.0),
    Binning("x", 12, 0.1, 10.0, 10),
    Binning("x", list(np.cumsum(np.random.default_rng(0).uniform(0.01, 0.1, 300)))),
]


def points(binning):
    rng = random.Random(1)
    xs = [rng.uniform(-2.0, 14.0) for _ in range(2000)]
    for edge in binning.edges:
        xs += [edge, math.nextafter(edge, -math.inf), math.nextafter(edge, math.inf)]
    return [float(x) for x in xs]


@pytest.mark.parametrize("binning", CASES, ids=range(len(CASES)))
def test_bins_against_bisect(spark, binning):
    xs = points(binning)
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    x = F.col("x")
    n = binning.n_bins
    for row in df.select("x", bin_clamped(x, binning).alias("c"), bin_right_closed(x, binning).alias("r")).collect():
        assert row.c == min(max(bisect.bisect_right(binning.edges, row.x) - 1, 0), n - 1)
        right = bisect.bisect_left(binning.edges, row.x) - 1
        assert row.r == (right if binning.edges[0] < row.x <= binning.edges[-1] else None)


def test_threshold_grid_is_exact(spark):
    edges = [i / 199 for i in range(200)]
    xs = points(Binning("x", edges)) + [0.0, 1.0, 2.0, -1.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    rows = df.select("x", grid_points_below(F.col("x"), 0.0, 1.0, 199, divided=True).alias("k")).collect()
    assert all(row.k == bisect.bisect_left(edges, row.x) for row in rows)


def test_nan_and_null(spark):
    df = spark.createDataFrame([(float("nan"),), (None,)], "x double")
    assert [r.b for r in df.select(bin_right_closed(F.col("x"), EXPLICIT).alias("b")).collect()] == [None, None]


def test_binning_values():
    log = Binning("x", 2, 1.0, 100.0, 10)
    assert np.allclose(log.edges, [1, 10, 100]) and log.n_bins == 2
    assert EXPLICIT.mids == [0.5, 1.75, 4.75, 8.5] and EXPLICIT.widths == [1.0, 1.5, 4.5, 3.0]
    assert EXPLICIT.labels[1] == "(1.0, 2.5]"
    assert EXPLICIT.same_as(Binning("x", [0.0, 1.0, 2.5, 7.0, 10.0 + 1e-12]))
    assert not EXPLICIT.same_as(Binning("y", list(EXPLICIT.edges)))
    for bad in ([1.0], [1.0, 1.0], [2.0, 1.0]):
        with pytest.raises(ValueError):
            Binning("x", bad)
    with pytest.raises(ValueError):
        Binning("x", 5)
