"""Training and physics weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkjets.functions.numeric import ratio
from sparkjets.operators.hist import count_per_bin


class EmptyBinError(ValueError):
    """A bin without rows has no flat weight."""


def flat_weights(df: DataFrame, bin_column: str, n_bins: int, norm: str = "unit") -> DataFrame:
    """One weight per bin, inversely proportional to its count: ``bin, n, w``.

    ``norm='unit'`` makes the weights of the bins sum to one, ``norm='total'``
    to the number of rows. An empty bin fails the query.
    """
    if norm not in ("unit", "total"):
        raise ValueError(f"unknown norm {norm!r}")
    counts = count_per_bin(df, bin_column, n_bins)
    message = F.concat(F.lit("empty bin "), F.col("bin").cast("string"), F.lit(": use fewer bins"))
    inverse = F.when(F.col("n") > 0, F.lit(1.0) / F.col("n")).otherwise(F.raise_error(message).cast("double"))
    with_inverse = counts.withColumn("_inv", inverse)
    every_bin = Window.partitionBy()  # over the n_bins rows of the count table, not over df
    weight = F.col("_inv") / F.sum("_inv").over(every_bin)
    if norm == "total":
        weight = weight * F.sum("n").over(every_bin)
    return with_inverse.select("bin", "n", weight.alias("w"))


def add_flat_weight(df: DataFrame, bin_column: str, n_bins: int, out: str = "weight", norm: str = "unit"):
    """Give every row the flat weight of its bin."""
    weights = flat_weights(df, bin_column, n_bins, norm).select(
        F.col("bin").alias(bin_column), F.col("w").alias(out)
    )
    return df.drop(out).join(F.broadcast(weights), bin_column)  # n_bins rows


def renormalise(df: DataFrame, weight: str, total: float | None = None, out: str | None = None) -> DataFrame:
    """Scale weights to mean one, or to the given sum."""
    sums = df.agg(F.sum(weight).alias("s"), F.count(weight).alias("n"))
    target = F.col("n").cast("double") if total is None else F.lit(float(total))
    factor = sums.select(ratio(target, F.col("s"))).scalar()
    return df.withColumn(out or weight, F.col(weight) * factor)


def divide_by_norm(df: DataFrame, weight: str, file_label: Column, norms) -> DataFrame:
    """Divide the weight by the norm of the dataset a row came from (labels count from 0)."""
    table = F.array(*[F.lit(float(n)) for n in norms])
    return df.withColumn(weight, ratio(F.col(weight), F.get(table, file_label)))
