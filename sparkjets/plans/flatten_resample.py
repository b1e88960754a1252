"""Events to a flat or physical spectrum of jets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkjets.functions.binning import Binning, bin_clamped, bin_with_class
from sparkjets.functions.labels import GLUON, QUARKS
from sparkjets.operators import combine, nested, resample, select


def flat_spectrum(
    events: DataFrame,
    binning: Binning,
    label: str,
    key: str,
    cuts: Mapping[str, nested.Limits] | None = None,
    wanted: Sequence[int] = (*QUARKS, *GLUON),
    max_jets: int | None = None,
    drop: Sequence[str] = (),
    mode: str = "weight",
    weight: str = "weight_flat",
    class_1: Sequence[int] = QUARKS,
    class_2: Sequence[int] = GLUON,
) -> DataFrame:
    """Flatten events and make the spectrum of both classes flat, by weights, truncation or rejection.

    The bin counts are a table of 2 * n_bins rows that is broadcast into the
    same plan; the jets are scanned twice and never shuffled, but for truncation.
    """
    jets = nested.flatten_events(events, label, wanted, cuts, max_jets, drop)
    options = {"weight": {"weight": weight}, "min_count": {"from_min_count": True}, "rejection": {}}
    if mode not in options:
        raise ValueError(f"unknown mode {mode!r}")
    return resample.resample_variable_by_class(jets, binning, label, key, class_1, class_2, **options[mode])


def class_bin(binning: Binning, label: str, class_1=QUARKS, class_2=GLUON):
    """The (class, bin) index that :func:`flat_spectrum` makes flat."""
    return bin_with_class(
        bin_clamped(F.col(binning.variable), binning), binning.n_bins, F.col(label), class_1, class_2
    )


def physical_spectrum(
    jets: DataFrame,
    description: DataFrame,
    metadata: DataFrame,
    weight_mc: str = "weight_mc",
    sample: str = "sample",
    luminosity: float = combine.LUMINOSITY,
    slice_column: str | None = None,
    slice_upper: Sequence[float] | None = None,
    weight_limits: nested.Limits = (None, None),
    drop_pattern: str | None = None,
) -> DataFrame:
    """Weight jets by cross section, filter efficiency and the norm of their sample.

    ``description`` has ``sample, cross_section, filt_eff, norm_name``. A sample
    without a description stops the job; list them first with
    :func:`sparkjets.operators.combine.missing_samples`.
    """
    if drop_pattern is not None:
        jets = select.drop_matching(jets, drop_pattern)
    if slice_column is not None:
        jets = select.slice_cut(jets, F.col(slice_column), upper=slice_upper)
    info = combine.normalisation(description, metadata, sample)
    weighted = combine.describe_samples(jets, info, sample).withColumn(
        "weight",
        combine.physical_weight(F.col(weight_mc), F.col("cross_section"), F.col("filt_eff"), F.col("norm"), luminosity),
    )
    if weight_limits != (None, None):
        weighted = select.cut(weighted, "weight", *weight_limits)
    return weighted.drop("cross_section", "filt_eff", "norm", "norm_name")
