"""Resampling to a target distribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkjets.functions.binning import Binning, bin_clamped, bin_joint, bin_with_class, class_split
from sparkjets.functions.labels import GLUON, QUARKS
from sparkjets.functions.random import random_order, uniform
from sparkjets.operators.hist import count_per_bin
from sparkjets.operators.ordered import BROADCAST_ROWS, HASH_BUCKETS, Buckets, keep_first
from sparkjets.operators.weights import add_flat_weight


def keep_min_count(
    df: DataFrame, bin_column: str, n_bins: int, order: str, inclusive: bool = False, min_count: int | None = None,
    buckets: Buckets | None = None,
) -> DataFrame:
    """Equal bins: of each bin the first rows in ``order``, as many as the smallest bin allows.

    The classic scan counts a row before it compares, so it keeps one row less
    than the smallest bin holds; ``inclusive`` keeps them all. ``order`` is a
    unique numeric arrival id. Only the rows near the limit of each bin are
    shuffled.
    """
    if min_count is None:
        counts = count_per_bin(df, bin_column, n_bins)
        empty = F.raise_error(F.lit("a bin is empty: use fewer bins")).cast("long")
        smallest = counts.agg(F.min("n").alias("m")).select(F.when(F.col("m") > 0, F.col("m")).otherwise(empty))
        limit = smallest.scalar()
    else:
        limit = F.lit(min_count)
    rows = df.where(F.col(bin_column).isNotNull())
    return keep_first(rows, order, limit if inclusive else limit - 1, [bin_column], buckets=buckets, known_partitions=n_bins)


def rejection_resample(
    df: DataFrame, bin_column: str, n_bins: int, key: str, target: Sequence[float] | None = None, seed: int = 42
) -> DataFrame:
    """Accept rows with probability (target / initial), scaled so that the largest is one.

    The acceptance table has one row per bin; the rows themselves are not shuffled.
    """
    shares = [1.0 / n_bins] * n_bins if target is None else [float(t) for t in target]
    if len(shares) != n_bins:
        raise ValueError("target needs one entry per bin")
    wanted = F.get(F.array(*[F.lit(s) for s in shares]), F.col("bin"))
    ratios = count_per_bin(df, bin_column, n_bins).select(
        "bin", F.when(F.col("n") > 0, wanted / F.col("n")).alias("r")
    )
    largest = F.max("r").over(Window.partitionBy())  # over the n_bins rows of the count table, not over df
    accept = ratios.select(F.col("bin").alias(bin_column), (F.col("r") / largest).alias("_accept"))
    small = n_bins <= BROADCAST_ROWS  # a row per bin
    joined = df.join(F.broadcast(accept) if small else accept, bin_column)
    return joined.where(uniform(key, seed=seed) < F.col("_accept")).drop("_accept")


def balanced_classes(df: DataFrame, label: str, classes: Sequence, key: str, seed: int = 42) -> DataFrame:
    """Equal numbers of every class: a hashed sample of the size of the smallest one."""
    index = F.lit(None).cast("int")
    for i, value in enumerate(classes):
        index = F.when(F.col(label) == value, i).otherwise(index)
    ready = df.withColumn("_class", index).withColumn("_order", random_order(key, seed=seed))
    kept = keep_min_count(ready, "_class", len(classes), "_order", inclusive=True, buckets=HASH_BUCKETS)
    return kept.drop("_class", "_order")


def resample(
    df: DataFrame,
    bin_index: Column,
    n_bins: int,
    key: str,
    weight: str | None = None,
    from_min_count: bool = False,
    target: Sequence[float] | None = None,
    seed: int = 42,
) -> DataFrame:
    """Flatten by truncation (``from_min_count``), by weights (``weight``) or by rejection."""
    binned = df.withColumn("_bin", bin_index)
    if from_min_count:
        result = keep_min_count(binned, "_bin", n_bins, key)
    elif weight is not None:
        result = add_flat_weight(binned, "_bin", n_bins, weight)
    else:
        result = rejection_resample(binned, "_bin", n_bins, key, target, seed)
    return result.drop("_bin")


def resample_variable(df, binning: Binning, key: str, **options) -> DataFrame:
    return resample(df, bin_clamped(F.col(binning.variable), binning), binning.n_bins, key, **options)


def resample_variable_by_class(
    df, binning: Binning, label: str, key: str, class_1=QUARKS, class_2=GLUON, **options
) -> DataFrame:
    index = bin_with_class(
        bin_clamped(F.col(binning.variable), binning), binning.n_bins, F.col(label), class_1, class_2
    )
    return resample(df, index, 2 * binning.n_bins, key, **options)


def joint_bin(first: Binning, second: Binning) -> Column:
    return bin_joint(
        bin_clamped(F.col(first.variable), first), bin_clamped(F.col(second.variable), second), second.n_bins
    )


def resample_two_variables(df, first: Binning, second: Binning, key: str, **options) -> DataFrame:
    return resample(df, joint_bin(first, second), first.n_bins * second.n_bins, key, **options)


def resample_two_variables_by_class(
    df, first: Binning, second: Binning, label: str, key: str, class_1=QUARKS, class_2=GLUON, **options
) -> DataFrame:
    cells = first.n_bins * second.n_bins
    index = bin_with_class(joint_bin(first, second), cells, F.col(label), class_1, class_2)
    return resample(df, index, 2 * cells, key, **options)


def resample_labels(df, label: str, key: str, class_1=QUARKS, class_2=GLUON, **options) -> DataFrame:
    return resample(df, class_split(F.col(label), class_1, class_2), 2, key, **options)
