"""Comparisons between models, generators and bins, on small tables of binned metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkjets.functions.numeric import ratio


def merge_classes(df: DataFrame, on: Sequence[str], label: str, values: Sequence[str], names=("_q", "_g")) -> DataFrame:
    """Rows of label 1 beside rows of label 0, with suffixes: keys that have both."""
    sides = [
        df.where(F.col(label) == value).select(*on, *[F.col(v).alias(v + name) for v in values])
        for value, name in zip((1, 0), names)
    ]
    return sides[0].join(sides[1], list(on))


def against_nominal(df: DataFrame, metric: str, nominal: Column, on: Sequence[str] = ("model",)) -> DataFrame:
    """Add the metric of the nominal sample (same ``on`` keys) and the ratio to it."""
    reference = df.where(nominal).select(*on, F.col(metric).alias(f"{metric}_nominal"))
    return df.join(reference, list(on)).withColumn("ratio", ratio(F.col(metric), F.col(f"{metric}_nominal")))


def mean_metric(df: DataFrame, metric: str, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(metric).alias(metric))


def sample_dependence(df: DataFrame, metric: str, nominal: Column, model: str = "model") -> DataFrame:
    """One minus the smallest ratio to the nominal sample, per model."""
    ratios = against_nominal(df, metric, nominal, [model])
    return ratios.groupBy(model).agg(
        (F.lit(1.0) - F.min("ratio")).alias("dependence"), F.first(f"{metric}_nominal").alias(f"{metric}_nominal")
    )


def matrix(df: DataFrame, rows: str | Sequence[str], columns: str, values: Sequence, metric: str) -> DataFrame:
    """Pivot one metric to a matrix; the column values are named, so no extra pass finds them."""
    keys = [rows] if isinstance(rows, str) else list(rows)
    return df.groupBy(*keys).pivot(columns, list(values)).agg(F.first(metric))


def envelope(df: DataFrame, reference: DataFrame, metric: str, on: Sequence[str] = ("model", "bin")) -> DataFrame:
    """Mean and maximum of \\|ratio - 1\\| and \\|difference\\| to a reference, per ``on``."""
    ref = reference.select(*on, F.col(metric).alias("_ref"))
    joined = df.join(ref, list(on))
    deviation = F.abs(ratio(F.col(metric), F.col("_ref")) - 1)
    difference = F.abs(F.col("_ref") - F.col(metric))
    return joined.groupBy(*on).agg(
        F.avg(deviation).alias("ratio_mean"),
        F.avg(difference).alias("diff_mean"),
        F.max(deviation).alias("ratio_max"),
        F.max(difference).alias("diff_max"),
    )


def largest_deviation(df: DataFrame, reference: DataFrame, metric: str, on: Sequence[str]) -> DataFrame:
    """Maximum of \\|1 - metric / reference\\| per ``on``."""
    ref = reference.select(*on, F.col(metric).alias("_ref"))
    worst = F.max(F.abs(F.lit(1.0) - ratio(F.col(metric), F.col("_ref"))))
    return df.join(ref, list(on)).groupBy(*on).agg(worst.alias("max_deviation"))


def sample_differences(
    df: DataFrame, metric: str, sample: str, pairs: Mapping[str, tuple[str, str]], nominal: str, on: Sequence[str]
) -> DataFrame:
    """Per key: (metric of one sample - metric of another) / metric of the nominal one, for named pairs."""
    names = {nominal, *[n for pair in pairs.values() for n in pair]}
    at = {n: F.max(F.when(F.col(sample) == n, F.col(metric))) for n in names}
    return df.groupBy(*on).agg(*[ratio(at[a] - at[b], at[nominal]).alias(out) for out, (a, b) in pairs.items()])


def model_ranking(technical: DataFrame, metrics: DataFrame, order: str = "auc", on: str = "model", top=None):
    """Technical information beside overall metrics, best first."""
    joined = technical.join(metrics, on).orderBy(F.col(order).desc(), on)
    return joined if top is None else joined.limit(top)
