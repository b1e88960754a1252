"""Unions, lookups and metadata."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkjets.functions.numeric import ratio
from sparkjets.functions.random import random_order
from sparkjets.operators.ordered import HASH_BUCKETS, keep_first

LUMINOSITY = 139_000.0  # fixed value: integrated luminosity in 1/pb


def same_schema(frames: Sequence[DataFrame]) -> bool:
    """Equal names and types; the order of the columns and nullability do not matter."""

    def shape(df: DataFrame):
        return sorted((f.name, f.dataType.simpleString()) for f in df.schema.fields)

    return all(shape(df) == shape(frames[0]) for df in frames[1:])


def concatenate(frames: Sequence[DataFrame], only_common: bool = False) -> DataFrame:
    """Union by name. Row order carries no meaning, so this is interleaving as well."""
    if not frames:
        raise ValueError("nothing to combine")
    if only_common:
        shared = [c for c in frames[0].columns if all(c in df.columns for df in frames[1:])]
        frames = [df.select(*shared) for df in frames]
    if not same_schema(frames):
        raise ValueError("datasets have different schemas")
    return reduce(DataFrame.unionByName, frames)


def sample_mix(
    frames: Sequence[DataFrame],
    key: str,
    weights: Sequence[float] | None = None,
    stop_on_empty: bool = True,
    seed: int = 42,
    only_common: bool = False,
) -> DataFrame:
    """Mix datasets in the proportion of ``weights``.

    When the mix must stop with the first exhausted dataset, dataset i gives
    floor(w_i * min_j(N_j / w_j)) rows: those that come first in a hashed order,
    which is a uniform sample and the same on every run. Otherwise, and when the
    weights are the size shares (the default), every row is used.
    """
    tagged = [df.withColumn("_source", F.lit(i)) for i, df in enumerate(frames)]
    everything = concatenate(tagged, only_common)
    if weights is None or not stop_on_empty:
        return everything.drop("_source")
    share = F.get(F.array(*[F.lit(float(w) / sum(weights)) for w in weights]), F.col("_source"))
    # a dataset without rows must count as size 0, so the sizes start from the list of sources
    counts = everything.groupBy("_source").agg(F.count(F.lit(1)).alias("n"))
    sources = everything.sparkSession.range(len(frames)).select(F.col("id").cast("int").alias("_source"))
    room = (
        sources.join(counts, "_source", "left")
        .agg(F.min(F.coalesce("n", F.lit(0)) / share).alias("room"))
        .scalar()
    )
    shuffled = everything.withColumn("_order", random_order(key, F.col("_source"), seed=seed))
    mixed = keep_first(shuffled, "_order", F.floor(share * room + 1e-9), ["_source"], [key], HASH_BUCKETS, known_partitions=len(frames))
    return mixed.drop("_source", "_order")


def combine_metadata(metadata: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Sum metadata values per key over all datasets."""
    return metadata.groupBy(key).agg(F.sum(value).alias(value))


def describe_samples(
    rows: DataFrame, description: DataFrame, on: str | Sequence[str], missing: str = "error"
) -> DataFrame:
    """Join rows to the sample description; Spark decides by its size whether it is broadcast.

    ``missing``: what a row without a description does: "error" stops the job and
    names the sample, "null" keeps the row without values, "drop" leaves it out.
    """
    if missing not in ("error", "null", "drop"):
        raise ValueError(f"unknown choice {missing!r}")
    if missing == "drop":
        return rows.join(description, on)
    keys = [on] if isinstance(on, str) else list(on)
    joined = rows.join(description.withColumn("_described", F.lit(True)), keys, "left")
    if missing == "error":
        text = F.concat(F.lit("no description of sample "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))
        joined = joined.where(F.coalesce("_described", F.raise_error(text).cast("boolean")))
    return joined.drop("_described")


def missing_samples(rows: DataFrame, description: DataFrame, on: str) -> DataFrame:
    """Sample names without a description."""
    return rows.select(on).distinct().join(description.select(on), on, "left_anti")


def normalisation(
    samples: DataFrame, metadata: DataFrame, sample="sample", norm_name="norm_name", missing: str = "error"
) -> DataFrame:
    """Add ``norm``: the metadata value that the sample's ``norm_name`` points to.

    ``missing``: a sample without it stops the job ("error") or keeps a NULL norm ("null").
    """
    if missing not in ("error", "null"):
        raise ValueError(f"unknown choice {missing!r}")
    named = metadata.select(
        F.col("sample").alias(sample), F.col("key").alias(norm_name), F.col("value").alias("norm")
    )
    joined = samples.join(named, [sample, norm_name], "left")
    if missing == "error":
        text = F.concat(F.lit("no norm "), F.coalesce(norm_name, F.lit("NULL")), F.lit(" of sample "), F.coalesce(sample, F.lit("NULL")))
        joined = joined.where(F.when(F.col("norm").isNotNull(), True).otherwise(F.raise_error(text).cast("boolean")))
    return joined


def physical_weight(
    weight_mc: Column, cross_section: Column, filter_efficiency: Column, norm: Column, luminosity: float = LUMINOSITY
) -> Column:
    """Nominal generator weight scaled to the luminosity."""
    return ratio(F.get(weight_mc, F.lit(0)) * F.lit(luminosity) * cross_section * filter_efficiency, norm)


def zip_rows(left: DataFrame, right: DataFrame, row_id: str) -> DataFrame:
    """Positional zip, on an explicit row id."""
    return left.join(right, row_id)


def add_scores(df: DataFrame, scores: DataFrame, row_id: str, name: str, score: str = "score") -> DataFrame:
    """Attach a score table as column ``name``."""
    return df.join(scores.select(row_id, F.col(score).alias(name)), row_id, "left")


def bind_on(tables: Mapping[str, DataFrame], on: str, value: str) -> DataFrame:
    """Column-bind one value per table, keeping keys that only some tables have."""
    parts = [t.select(on, F.lit(name).alias("_name"), F.col(value).alias("_value")) for name, t in tables.items()]
    stacked = reduce(DataFrame.unionByName, parts)
    return stacked.groupBy(on).pivot("_name", list(tables)).agg(F.first("_value", ignorenulls=True))
