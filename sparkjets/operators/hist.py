"""Histograms and counting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkjets.functions.binning import Binning, bin_clamped
from sparkjets.functions.numeric import ratio


def count_per_bin(df: DataFrame, bin_column: str | Column, n_bins: int, out: str = "n") -> DataFrame:
    """Rows per bin, with a row for each of the ``n_bins`` bins, empty ones included."""
    index = F.col(bin_column) if isinstance(bin_column, str) else bin_column
    counts = df.groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias(out))
    bins = df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    # counts has at most n_bins + 1 rows: small by construction
    return bins.join(F.broadcast(counts), "bin", "left").na.fill(0, [out])


def histogram(df: DataFrame, binning: Binning, weight: str | None = None, out: str = "value") -> DataFrame:
    """Weighted histogram; values outside count in the edge bins. Every bin is listed."""
    return histogram_multiple(df, [binning], weight, out).drop("variable")


def histogram_multiple(df: DataFrame, binnings: Sequence[Binning], weight=None, out: str = "value") -> DataFrame:
    """Histograms of many variables in one scan: ``variable, bin, bin_lo, bin_hi, value``."""
    if len({b.variable for b in binnings}) != len(binnings):
        raise ValueError("give each variable one binning")
    entries = [
        F.struct(F.lit(b.variable).alias("variable"), bin_clamped(F.col(b.variable), b).alias("bin")) for b in binnings
    ]
    amount = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    filled = (
        df.select(F.explode(F.array(*entries)).alias("e"), amount.alias("_w"))
        .groupBy(F.col("e.variable").alias("variable"), F.col("e.bin").alias("bin"))
        .agg(F.sum("_w").alias(out))
    )
    return bin_frame(df, binnings).join(F.broadcast(filled), ["variable", "bin"], "left").na.fill(0.0, [out])


def bin_frame(df: DataFrame, binnings: Sequence[Binning]) -> DataFrame:
    rows = [
        (b.variable, i, lo, hi) for b in binnings for i, (lo, hi) in enumerate(zip(b.edges, b.edges[1:]))
    ]
    return df.sparkSession.createDataFrame(rows, "variable string, bin int, bin_lo double, bin_hi double")


def histogram_by(
    df: DataFrame,
    binning: Binning,
    hue: Sequence[str] = (),
    weight: str | None = None,
    stat: str = "count",
    common_norm: bool = False,
) -> DataFrame:
    """Histogram per hue as count, probability or density.

    With ``common_norm`` all hues together are normalised to one, else each hue.
    Counts also work on a streaming frame, in complete mode.
    The normalising window runs on the binned table, not on the rows.
    """
    if stat not in ("count", "probability", "density"):
        raise ValueError(f"unknown stat {stat!r}")
    amount = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    binned = df.groupBy(*hue, bin_clamped(F.col(binning.variable), binning).alias("bin")).agg(
        F.sum(amount).alias("value")
    )
    if stat == "count":
        return binned
    whole = Window.partitionBy(*([] if common_norm else hue))
    share = ratio(F.col("value"), F.sum("value").over(whole))
    if stat == "density":
        widths = F.array(*[F.lit(w) for w in binning.widths])
        share = share / F.get(widths, F.col("bin"))
    return binned.withColumn("value", share)


def class_histograms(
    df: DataFrame, binnings: Sequence[Binning], label: str, weight: str | None = None
) -> DataFrame:
    """Probability histogram per variable and class, all variables in one scan."""
    entries = [
        F.struct(F.lit(b.variable).alias("variable"), bin_clamped(F.col(b.variable), b).alias("bin")) for b in binnings
    ]
    amount = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    filled = (
        df.select(label, F.explode(F.array(*entries)).alias("e"), amount.alias("_w"))
        .where(F.col("e.bin").isNotNull())
        .groupBy(F.col("e.variable").alias("variable"), label, F.col("e.bin").alias("bin"))
        .agg(F.sum("_w").alias("value"))
    )
    per_class = Window.partitionBy("variable", label)
    return filled.withColumn("probability", ratio(F.col("value"), F.sum("value").over(per_class)))


def weighted_fraction(df: DataFrame, condition: Column, weight: str | None = None, by: Sequence[str] = ()):
    """Share of the weight that satisfies a condition: ``selected, total, fraction``."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    sums = df.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(condition, w)), F.lit(0.0)).alias("selected"), F.sum(w).alias("total")
    )
    return sums.withColumn("fraction", ratio(F.col("selected"), F.col("total")))


def unmatched_report(
    jets: DataFrame, slice_column: str, parton: str, accepted: Column, matched: Sequence[int], pileup: int = -1
) -> DataFrame:
    """Jets, unmatched jets and pile-up jets inside the acceptance, per slice and in total (slice NULL)."""
    inside = jets.where(accepted)
    known = F.col(parton).isin([*matched, pileup])
    counts = inside.rollup(slice_column).agg(
        F.count(F.lit(1)).alias("jets"),
        F.count(F.when(~F.coalesce(known, F.lit(False)), 1)).alias("unmatched"),
        F.count(F.when(F.col(parton) == pileup, 1)).alias("pileup"),
    )
    return counts.withColumn("unmatched_fraction", ratio(F.col("unmatched"), F.col("jets"))).withColumn(
        "pileup_fraction", ratio(F.col("pileup"), F.col("jets"))
    )


def quark_gluon_ratio(df: DataFrame, bin_column: str, label: str, weight: str, by: Sequence[str] = ()) -> DataFrame:
    """Weight of label 1 over label 0 per bin, with its statistical error."""
    w = F.col(weight).cast("double")
    quark, gluon = F.col(label) == 1, F.col(label) == 0
    sums = df.groupBy(*by, bin_column).agg(
        F.sum(F.when(quark, w)).alias("weight_q"),
        F.sqrt(F.sum(F.when(quark, w * w))).alias("error_q"),
        F.sum(F.when(gluon, w)).alias("weight_g"),
        F.sqrt(F.sum(F.when(gluon, w * w))).alias("error_g"),
    )
    relative = [ratio(F.col(f"error_{s}"), F.col(f"weight_{s}")) for s in "qg"]
    return (
        sums.where(F.col("weight_q").isNotNull() & F.col("weight_g").isNotNull())
        .withColumn("frac", ratio(F.col("weight_q"), F.col("weight_g")))
        .withColumn("frac_err", F.col("frac") * F.sqrt(relative[0] * relative[0] + relative[1] * relative[1]))
    )


def weight_bin_edges(df: DataFrame, value: str, weight: str, label: str, scale: float = 1.0, shift: float = 1e-6):
    """Bin edges of a spectrum that was flattened by weights: the smallest gluon value of each weight.

    One more edge closes the last bin: the largest non-gluon value of the
    largest weight. Edges are rounded to three decimals and made distinct.
    """
    x = F.col(value) * scale
    starts = df.where(F.col(label) == 21).groupBy(weight).agg(F.min(x).alias("edge")).select("edge")
    top = df.where(F.col(label) != 21).groupBy(weight).agg(F.max(x).alias("edge"))
    last = top.agg(F.max(F.struct(F.col(weight), F.col("edge")))["edge"].alias("edge"))
    return starts.union(last).select(F.round(F.col("edge") + shift, 3).alias("edge")).distinct()
