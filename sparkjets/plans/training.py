"""Jets to a training table: cut, augment, label, features, padding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkjets.functions.arrays import one_hot
from sparkjets.functions.augment import augment
from sparkjets.functions.features import add_features
from sparkjets.functions.labels import class_index
from sparkjets.operators import select, weights


def training_table(
    jets: DataFrame,
    feature_set: str,
    target: str,
    label_groups: Sequence,
    key: str,
    weight: str | None = None,
    cut: str | select.Cut | None = None,
    unknown_labels: Sequence | None = None,
    augmentations: Sequence[tuple[str, Mapping]] | None = None,
    file_label: str | None = None,
    dataset_norms: Sequence[float] | None = None,
    max_constituents: int | None = None,
    seed: int = 42,
    **feature_options,
) -> DataFrame:
    """``key, features, label[, weight]``: one row per jet, no shuffle from scan to sink.

    The cut comes first, so what of it is scalar reaches the Parquet reader.
    """
    if dataset_norms is not None:
        jets = weights.divide_by_norm(jets, weight, F.col(file_label), dataset_norms)
    if cut is not None:
        jets = select.where(jets, cut)
    if unknown_labels is not None:
        jets = select.drop_values(jets, target, unknown_labels)
    if augmentations:
        jets = augment(jets, key, augmentations, seed)
    label = class_index(F.col(target), label_groups)
    if len(label_groups) > 2:
        label = one_hot(label, len(label_groups))
    ready = add_features(jets, feature_set, "features", max_constituents=max_constituents, **feature_options)
    columns = [F.col(key), F.col("features"), label.alias("label")]
    if weight is not None:
        columns.append(F.col(weight).alias("weight"))
    return ready.select(*columns)
