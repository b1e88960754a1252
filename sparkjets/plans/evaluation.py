"""Scored jets to overall and binned metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkjets.functions.binning import Binning
from sparkjets.operators import metrics


def by_model(df: DataFrame, scores: Mapping[str, str], keep: Sequence[str]) -> DataFrame:
    """One row per jet and model, ``model, score`` and the kept columns: all models share one scan."""
    entries = [F.struct(F.lit(m).alias("model"), F.col(c).alias("score")) for m, c in scores.items()]
    return df.select(*keep, F.explode(F.array(*entries)).alias("_s")).select(*keep, "_s.model", "_s.score")


def evaluate(
    df: DataFrame,
    scores: Mapping[str, str],
    label: str,
    weight: str | None = None,
    binnings: Sequence[Binning] = (),
    cuts: Mapping[str, Column] | None = None,
    threshold: float = 0.5,
) -> tuple[DataFrame, DataFrame | None]:
    """Overall metrics per model, and metrics per (model, cut, variable, bin) where binnings are given."""
    extra = [weight] if weight else []
    overall = metrics.all_metrics(
        by_model(df, scores, [label, *extra]), "score", label, weight, ["model"], threshold
    )
    if not binnings:
        return overall, None
    return overall, metrics.metrics_by_cut(df, binnings, cuts or {"all": F.lit(True)}, scores, label, weight, threshold)
