"""Tagging metrics over scored rows.

Scores are bucketed against an even grid of thresholds first; one partial
aggregation by (group, bucket) then holds everything a threshold scan needs.
Nothing is multiplied by the number of thresholds, and the windows run on at
most ``num_thresholds + 1`` rows per group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkjets.functions.arrays import argmax
from sparkjets.functions.binning import Binning, bin_right_closed, grid_points_below
from sparkjets.functions.numeric import ratio
from sparkjets.operators.hist import histogram_by
from sparkjets.operators.ordered import running_totals

NUM_THRESHOLDS = 200


def _weight(weight: str | None) -> Column:
    return F.lit(1.0) if weight is None else F.col(weight).cast("double")


def sum_if(condition: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0.0))


# ------------------------------------------------------- single-threshold sums


def efficiency(label: Column, score: Column, w: Column, label_id: int, threshold) -> Column:
    """Aggregate: share of class ``label_id`` on its own side of the threshold."""
    own = label == label_id
    right = score > threshold if label_id == 1 else score <= threshold
    return ratio(sum_if(own & right, w), sum_if(own, w))


def rejection(label: Column, score: Column, w: Column, label_id: int, threshold) -> Column:
    """Aggregate: 1 / (1 - efficiency); NULL when nothing passes."""
    return ratio(F.lit(1.0), F.lit(1.0) - efficiency(label, score, w, label_id, threshold))


def binary_accuracy(label: Column, score: Column, w: Column, threshold: float = 0.5) -> Column:
    """Aggregate: weighted share of right predictions."""
    return ratio(sum_if((score > threshold).cast("int") == label, w), F.sum(w))


def effective_events(w: Column, condition: Column | None = None) -> Column:
    """Aggregate: squared sum of weights over the sum of squared weights."""
    w = w if condition is None else F.when(condition, w)
    return ratio(F.sum(w) * F.sum(w), F.sum(w * w))


# Default bins of the effective tagging efficiency.
DILUTION_BINS = (0, 0.1, 0.25, 0.5, 0.625, 0.75, 0.875, 1)


def effective_tagging_efficiency(
    df: DataFrame, score: str, label: str, bins: Sequence[float] = DILUTION_BINS, by: Sequence[str] = ()
) -> DataFrame:
    """Sum over dilution bins of share * (1 - 2 * wrong share)^2; a dilution of 0 is not counted."""
    if any(b < 0 or b > 1 for b in bins):
        raise ValueError("bins must lie between 0 and 1")
    dilution = F.abs(2 * F.col(score) - 1)
    wrong = ((F.col(score) > 0.5).cast("int") != F.col(label)).cast("int")
    per_bin = (
        df.withColumn("_d", bin_right_closed(dilution, Binning("dilution", list(bins))))
        .where(F.col("_d").isNotNull())
        .groupBy(*by, "_d")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(wrong).alias("bad"))
    )
    term = F.col("n") * F.pow(1 - 2 * F.col("bad") / F.col("n"), 2)
    return per_bin.groupBy(*by).agg((F.sum(term) / F.sum("n")).alias("effective_tagging_efficiency"))


# -------------------------------------------------------------- threshold scan


def score_buckets(
    df: DataFrame,
    score: str,
    label: str,
    weight: str | None = None,
    by: Sequence[str] = (),
    num_thresholds: int = NUM_THRESHOLDS,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Weights per class and score bucket ``k`` = number of thresholds below the score."""
    w = _weight(weight)
    k = grid_points_below(F.col(score), 0.0, 1.0, num_thresholds - 1, divided=True)
    return df.groupBy(*by, k.alias("k")).agg(
        sum_if(F.col(label) == 1, w).alias("w_pos"), sum_if(F.col(label) == 0, w).alias("w_neg"), *extra
    )


def _scan(buckets: DataFrame, by: Sequence[str], num_thresholds: int, carry: Sequence[Column] = ()) -> DataFrame:
    """One row per group and threshold from bucket sums; ``carry`` are aggregates kept for the group.

    A group's buckets travel as one map of at most ``num_thresholds + 1`` entries.
    """
    last = num_thresholds - 1
    packed = buckets.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("k", F.struct("w_pos", "w_neg")))).alias("_m"),
        F.sum("w_pos").alias("total_pos"),
        F.sum("w_neg").alias("total_neg"),
        *carry,
    )
    rows = packed.withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(last))))
    step = F.try_element_at("_m", F.col("idx") + 1)
    above = Window.partitionBy(*by).orderBy(F.col("idx").desc()).rowsBetween(Window.unboundedPreceding, 0)
    threshold = F.col("idx").cast("double") / F.lit(float(last))
    return (
        rows.withColumn("tp", F.sum(F.coalesce(step["w_pos"], F.lit(0.0))).over(above))
        .withColumn("fp", F.sum(F.coalesce(step["w_neg"], F.lit(0.0))).over(above))
        .withColumn("threshold", threshold)
        .withColumn("tpr", ratio(F.col("tp"), F.col("total_pos")))
        .withColumn("tnr", ratio(F.col("total_neg") - F.col("fp"), F.col("total_neg")))
        .drop("_m")
    )


def threshold_table(df, score, label, weight=None, by=(), num_thresholds: int = NUM_THRESHOLDS) -> DataFrame:
    """Per threshold: efficiency of label 1 (``tpr``) and of label 0 (``tnr``)."""
    buckets = score_buckets(df, score, label, weight, by, num_thresholds)
    return _scan(buckets, by, num_thresholds).select(*by, "idx", "threshold", "tpr", "tnr")


def _closest(fixed: Column, target) -> Column:
    """Aggregate: the row whose ``fixed`` value is nearest to the target, the first on ties."""
    miss = fixed - target
    return F.min(
        F.when(
            fixed.isNotNull(),
            F.struct((miss * miss).alias("miss"), F.col("idx"), F.col("tpr"), F.col("tnr"), F.col("threshold")),
        )
    )


def working_point(
    df, score, label, target: float = 0.5, fixed_label: int = 1, weight=None, by=(), num_thresholds=NUM_THRESHOLDS
) -> DataFrame:
    """Efficiencies and threshold where the efficiency of ``fixed_label`` is nearest to the target."""
    table = threshold_table(df, score, label, weight, by, num_thresholds)
    fixed = F.col("tpr") if fixed_label == 1 else F.col("tnr")
    best = table.groupBy(*by).agg(_closest(fixed, F.lit(float(target))).alias("b"))
    return best.select(*by, *[F.col("b")[n].alias(n) for n in ("tpr", "tnr", "threshold")])


def at_working_point(
    df, score, label, target=0.5, fixed_label=1, returned_label=0, weight=None, by=(), num_thresholds=NUM_THRESHOLDS
) -> DataFrame:
    """Efficiency, rejection and threshold of ``returned_label`` at a working point of ``fixed_label``."""
    point = working_point(df, score, label, target, fixed_label, weight, by, num_thresholds)
    eff = F.col("tpr") if returned_label == 1 else F.col("tnr")
    return point.select(
        *by,
        eff.alias("efficiency"),
        ratio(F.lit(1.0), F.lit(1.0) - eff).alias("rejection"),
        "threshold",
    )


def rejection_at_efficiency(
    df, score, label, efficiency: float, label_id: int = 1, weight=None, by=(), num_thresholds=NUM_THRESHOLDS
) -> DataFrame:
    """1 / specificity where the sensitivity of ``label_id`` is nearest to ``efficiency``."""
    point = working_point(df, score, label, efficiency, label_id, weight, by, num_thresholds)
    other = F.col("tnr") if label_id == 1 else F.col("tpr")
    return point.select(*by, ratio(F.lit(1.0), other).alias("rejection"), "threshold")


def rejection_curve(
    df, score, label, weight=None, fixed_label=1, min_efficiency=0.04, by=(), num_thresholds=NUM_THRESHOLDS
) -> DataFrame:
    """Background rejection against signal efficiency: distinct efficiencies above a minimum, sorted."""
    table = threshold_table(df, score, label, weight, by, num_thresholds)
    x, y = ("tpr", "tnr") if fixed_label == 1 else ("tnr", "tpr")
    distinct = table.groupBy(*by, F.col(x).alias("sig_eff")).agg(F.min(F.struct("idx", F.col(y).alias("y"))).alias("f"))
    return (
        distinct.where(F.col("sig_eff") > min_efficiency)
        .select(*by, "sig_eff", ratio(F.lit(1.0), F.lit(1.0) - F.col("f.y")).alias("bkg_rej"))
        .orderBy(*by, "sig_eff")
    )


# ------------------------------------------------------------- AUC, ROC, counts


def _by_score(df, score, label, weight, by) -> DataFrame:
    w = _weight(weight)
    return (
        df.where(F.col(label).isin(0, 1))
        .groupBy(*by, score)
        .agg(sum_if(F.col(label) == 1, w).alias("w_pos"), sum_if(F.col(label) == 0, w).alias("w_neg"))
    )


def auc(df, score, label, weight=None, by=()) -> DataFrame:
    """Exact area under the ROC curve, tied scores counted half."""
    points = running_totals(
        _by_score(df, score, label, weight, by), score, {"cum_neg": F.col("w_neg")}, list(by)
    )
    area = F.sum(F.col("w_pos") * (F.col("cum_neg") - F.col("w_neg") * 0.5))
    return points.groupBy(*by).agg(ratio(area, F.sum("w_pos") * F.sum("w_neg")).alias("auc"))


def roc_points(df, score, label, weight=None) -> DataFrame:
    """False and true positive rate at every distinct score, weighted."""
    scores = _by_score(df, score, label, weight, ()).withColumn("_minus", -F.col(score))
    points = running_totals(
        scores, "_minus", {"tp": F.col("w_pos"), "fp": F.col("w_neg")}
    )
    totals = scores.agg(F.struct(F.sum("w_pos").alias("p"), F.sum("w_neg").alias("n")).alias("t")).scalar()
    return points.select(
        F.col(score).alias("threshold"),
        ratio(F.col("fp"), totals["n"]).alias("fpr"),
        ratio(F.col("tp"), totals["p"]).alias("tpr"),
    )


def confusion_matrix(df, label, predicted, classes: Sequence, weight=None) -> DataFrame:
    """Weighted confusion matrix, each row scaled to per mille and rounded."""
    w = _weight(weight)
    cells = [sum_if(F.col(predicted) == c, w) for c in classes]
    whole = F.sum(w)
    return (
        df.where(F.col(label).isin(list(classes)) & F.col(predicted).isin(list(classes)))
        .groupBy(label)
        .agg(*[F.round(ratio(cell * 1000, whole)).alias(f"pred_{c}") for cell, c in zip(cells, classes)])
    )


def score_histogram(df, score, label, bins: int = 50, weight=None) -> DataFrame:
    """Score histogram per class."""
    return histogram_by(df, Binning(score, bins, 0.0, 1.0), [label], weight)


def tag_counts(df, truth, predicted) -> DataFrame:
    """Rows per truth label and predicted tag."""
    return df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------ all at once


# Names of the metrics.
METRICS = (
    "binary_accuracy",
    "auc",
    "gluon_efficiency",
    "quark_efficiency",
    "gluon_rejection",
    "quark_rejection",
    "gluon_rejection_at_quark_50wp",
    "threshold_at_fixed_quark_50wp",
)


#: Sums of a metric state beside the weights of both classes.
STATE_SUMS = ("w", "ww", "ww_pos", "ww_neg", "right", "pass_pos", "pass_neg", "n")


def metric_state(
    df: DataFrame,
    score: str,
    label: str,
    weight: str | None = None,
    by: Sequence[str] = (),
    threshold: float | str = 0.5,
    num_thresholds: int = NUM_THRESHOLDS,
) -> DataFrame:
    """What all metrics need of the rows: sums per group and score bucket, at most ``num_thresholds + 1`` rows a group.

    States of disjoint sets of rows are merged by adding them up (:func:`merge_states`),
    in any order, and give the metrics of all rows (:func:`metrics_of_state`).
    """
    w, s, y = _weight(weight), F.col(score), F.col(label)
    cut = F.col(threshold) if isinstance(threshold, str) else F.lit(float(threshold))
    known = df.where(y.isin(0, 1))
    sums = {
        "w": F.sum(w),
        "ww": F.sum(w * w),
        "ww_pos": sum_if(y == 1, w * w),
        "ww_neg": sum_if(y == 0, w * w),
        "right": sum_if((s > 0.5).cast("int") == y, w),
        "pass_pos": sum_if((y == 1) & (s > cut), w),
        "pass_neg": sum_if((y == 0) & (s <= cut), w),
        "n": F.count(F.lit(1)),
    }
    return score_buckets(
        known, score, label, weight, by, num_thresholds, [c.alias(f"s_{name}") for name, c in sums.items()]
    )


def merge_states(state: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """States laid one under the other, added up."""
    sums = ["w_pos", "w_neg", *(f"s_{name}" for name in STATE_SUMS)]
    return state.groupBy(*by, "k").agg(*[F.sum(c).alias(c) for c in sums])


def save_state(state: DataFrame, path: str, chunk: int) -> None:
    """Keep the state of a chunk. A chunk that is done again replaces its state, so it counts once."""
    state.write.mode("overwrite").parquet(f"{path.rstrip('/')}/chunk={int(chunk)}")


def load_state(spark, path: str, by: Sequence[str] = ()) -> DataFrame:
    """The merged state of all chunks kept so far."""
    return merge_states(spark.read.parquet(path), by)


def all_metrics(
    df: DataFrame,
    score: str,
    label: str,
    weight: str | None = None,
    by: Sequence[str] = (),
    threshold: float | str = 0.5,
    num_thresholds: int = NUM_THRESHOLDS,
) -> DataFrame:
    """All tagging metrics and event counts per group, from one scan of the rows.

    ``threshold`` is a number or the name of a column (a per-bin threshold).
    The area is the trapezoid over the thresholds of the scan.
    """
    return metrics_of_state(metric_state(df, score, label, weight, by, threshold, num_thresholds), by, num_thresholds)


def metrics_of_state(state: DataFrame, by: Sequence[str] = (), num_thresholds: int = NUM_THRESHOLDS) -> DataFrame:
    """All tagging metrics and event counts per group of a (merged) state."""
    scan = _scan(state, by, num_thresholds, [F.sum(f"s_{name}").alias(f"s_{name}") for name in STATE_SUMS])
    ordered = Window.partitionBy(*by).orderBy("idx")
    # at the ends of the curve everything passes, or nothing does
    first, last = F.col("idx") == 0, F.col("idx") == num_thresholds - 1
    x = F.when(first, F.col("total_neg")).when(last, 0.0).otherwise(F.col("fp"))
    y_up = F.when(first, F.col("total_pos")).when(last, 0.0).otherwise(F.col("tp"))
    scan = scan.withColumns({"_x": x, "_y": y_up})
    strip = (F.lag("_x").over(ordered) - F.col("_x")) * (F.lag("_y").over(ordered) + F.col("_y")) / 2
    scan = scan.withColumn("_strip", strip)
    kept = [f"s_{name}" for name in STATE_SUMS] + ["total_pos", "total_neg"]
    final = scan.groupBy(*by).agg(
        F.sum("_strip").alias("area"),
        _closest(F.col("tpr"), F.lit(0.5)).alias("wp"),
        *[F.first(c).alias(c) for c in kept],
    )
    pos, neg = F.col("total_pos"), F.col("total_neg")
    gluon, quark = ratio(F.col("s_pass_neg"), neg), ratio(F.col("s_pass_pos"), pos)
    one = F.lit(1.0)
    return final.select(
        *by,
        ratio(F.col("s_right"), F.col("s_w")).alias("binary_accuracy"),
        ratio(F.col("area"), pos * neg).alias("auc"),
        gluon.alias("gluon_efficiency"),
        quark.alias("quark_efficiency"),
        ratio(one, one - gluon).alias("gluon_rejection"),
        ratio(one, one - quark).alias("quark_rejection"),
        ratio(one, one - F.col("wp.tnr")).alias("gluon_rejection_at_quark_50wp"),
        F.col("wp.threshold").alias("threshold_at_fixed_quark_50wp"),
        F.col("s_n").alias("num_events"),
        ratio(F.col("s_w") * F.col("s_w"), F.col("s_ww")).alias("eff_num_events"),
        ratio(pos * pos, F.col("s_ww_pos")).alias("eff_num_events_q"),
        ratio(neg * neg, F.col("s_ww_neg")).alias("eff_num_events_g"),
    )


def binned_metrics(
    df: DataFrame,
    binning: Binning,
    score: str,
    label: str,
    weight: str | None = None,
    threshold: float | DataFrame = 0.5,
    by: Sequence[str] = (),
    keep_empty: bool = True,
) -> DataFrame:
    """All metrics per right-closed bin. Every bin is listed, an empty one with NULL metrics.

    ``threshold`` is a number, or a table ``(bin, value)`` made for the same binning.
    """
    binned = df.withColumn("bin", bin_right_closed(F.col(binning.variable), binning))
    if not (by and keep_empty):  # rows of no bin stay where they tell that their group exists
        binned = binned.where(F.col("bin").isNotNull())
    limit: float | str = 0.5
    if isinstance(threshold, DataFrame):
        # one row per bin of this binning, whatever the table holds: small by construction
        per_bin = threshold.where(F.col("bin").between(0, binning.n_bins - 1)).groupBy("bin")
        per_bin = per_bin.agg(F.first("value").alias("_threshold"))
        binned, limit = binned.join(F.broadcast(per_bin), "bin", "left"), "_threshold"
    else:
        limit = threshold
    metrics = all_metrics(binned, score, label, weight, [*by, "bin"], limit)
    bins = binning.table(df.sparkSession)
    if not keep_empty:
        return metrics.join(F.broadcast(bins), "bin")  # n_bins rows
    if not by:
        return bins.join(metrics, "bin", "left")
    # every bin of every group; a group's metrics are n_bins entries at most
    values = [c for c in metrics.columns if c not in (*by, "bin")]
    entry = F.when(F.col("bin").isNotNull(), F.struct("bin", F.struct(*values)))
    groups = metrics.groupBy(*by).agg(F.map_from_entries(F.collect_list(entry)).alias("_found"))
    listed = groups.select(*by, "_found", F.explode(F.sequence(F.lit(0), F.lit(binning.n_bins - 1))).alias("bin"))
    listed = listed.withColumn("_own", F.try_element_at("_found", F.col("bin")))
    return listed.select(*by, "bin", *[F.col("_own")[v].alias(v) for v in values]).join(F.broadcast(bins), "bin")


def metrics_by_cut(
    df: DataFrame,
    binnings: Sequence[Binning],
    cuts: Mapping[str, Column],
    score: str | Mapping[str, str],
    label: str,
    weight: str | None = None,
    threshold: float = 0.5,
) -> DataFrame:
    """Binned metrics for every (cut, binning) pair in one scan: ``cut, variable, bin, ...``.

    With several models (name -> score column) they share the scan too, and ``model`` comes first.

    A row counts once for each cut it passes and each binning it falls into. Every bin of
    every pair is listed, an empty one with NULL metrics.
    """
    names = F.array(*[F.when(condition, F.lit(name)) for name, condition in cuts.items()])
    slots = [
        F.struct(F.lit(b.variable).alias("variable"), bin_right_closed(F.col(b.variable), b).alias("bin"))
        for b in binnings
    ]
    models = {} if isinstance(score, str) else dict(score)
    entries = [F.struct(F.lit(m).alias("model"), F.col(c).alias("score")) for m, c in models.items()]
    scored = F.col(score) if isinstance(score, str) else F.explode(F.array(*entries)).alias("_model")
    spread = (
        df.select(scored, label, *([weight] if weight else []), names.alias("_cuts"), F.array(*slots).alias("_slots"))
        .withColumn("cut", F.explode(F.array_compact("_cuts")))
        .withColumn("_slot", F.explode(F.filter("_slots", lambda s: s["bin"].isNotNull())))
        .withColumns({"variable": F.col("_slot")["variable"], "bin": F.col("_slot")["bin"]})
        .drop("_cuts", "_slots", "_slot")
    )
    by = ["cut", "variable", "bin"]
    every = [(name, b.variable, i) for name in cuts for b in binnings for i in range(b.n_bins)]
    schema = "cut string, variable string, bin int"
    if models:
        spread = spread.select("*", "_model.*").drop("_model")
        by, every, schema, score = ["model", *by], [(m, *e) for m in models for e in every], f"model string, {schema}", "score"
    found = all_metrics(spread, score, label, weight, by, threshold)
    return df.sparkSession.createDataFrame(every, schema).join(found, by, "left")


def bin_thresholds(
    df, binning: Binning, score, label, target=0.5, weight=None, num_thresholds=NUM_THRESHOLDS
) -> DataFrame:
    """Per-bin threshold at a fixed efficiency of label 1: a table ``variable, bin, bin_lo, bin_hi, value``."""
    binned = df.withColumn("bin", bin_right_closed(F.col(binning.variable), binning)).where(F.col("bin").isNotNull())
    points = working_point(binned, score, label, target, 1, weight, ["bin"], num_thresholds)
    bins = binning.table(df.sparkSession).select("bin", "bin_lo", "bin_hi")
    return bins.join(points.select("bin", F.col("threshold").alias("value")), "bin", "left").select(
        F.lit(binning.variable).alias("variable"), "bin", "bin_lo", "bin_hi", "value"
    )


def efficiency_grid(
    df: DataFrame,
    first: Binning,
    second: Binning,
    score: str,
    label: str,
    weight: str,
    targets: Sequence[float] = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9),
    num_thresholds: int = NUM_THRESHOLDS,
) -> DataFrame:
    """Gluon efficiency in a grid of two variables at several quark working points, with its error.

    All working points come from one threshold scan.
    """
    w = _weight(weight)
    binned = df.select(
        bin_right_closed(F.col(first.variable), first).alias("bin_1"),
        bin_right_closed(F.col(second.variable), second).alias("bin_2"),
        score,
        label,
        weight,
    ).where(F.col("bin_1").isNotNull() & F.col("bin_2").isNotNull())
    by = ["bin_1", "bin_2"]
    squares = sum_if(F.col(label) == 0, w * w).alias("s_ww")
    buckets = score_buckets(binned, score, label, weight, by, num_thresholds, [squares])
    scan = _scan(buckets, by, num_thresholds, [F.sum("s_ww").alias("s_ww")])
    best = scan.groupBy(*by).agg(
        F.first(ratio(F.col("total_neg") * F.col("total_neg"), F.col("s_ww"))).alias("n_g"),
        F.array(
            *[
                F.struct(F.lit(t).alias("quark_efficiency"), _closest(F.col("tpr"), F.lit(t))["tnr"].alias("tnr"))
                for t in targets
            ]
        ).alias("points"),
    )
    eff = F.lit(1.0) - F.col("p.tnr")
    return best.select(*by, "n_g", F.explode("points").alias("p")).select(
        *by,
        F.col("p.quark_efficiency").alias("quark_efficiency"),
        eff.alias("gluon_efficiency"),
        F.sqrt(ratio(eff * (F.lit(1.0) - eff), F.col("n_g"))).alias("stat_err"),
    )


def metric_errors(
    df: DataFrame,
    metrics: Sequence[str],
    counts: Mapping[str, str] | None = None,
    suffix: str = "_err",
) -> DataFrame:
    """Binomial errors: sqrt(v(1-v)/n) for efficiencies and accuracies, scaled by v^2 for rejections.

    Quark metrics use the effective quark count, gluon metrics the gluon count,
    others the count of all events. Metrics of another family get no error.
    """

    def count_of(name: str) -> Column:
        if counts and name in counts:
            return F.col(counts[name])
        if name.startswith("quark"):
            return F.col("eff_num_events_q")
        return F.col("eff_num_events_g") if name.startswith("gluon") else F.col("eff_num_events")

    errors = {}
    for name in metrics:
        v, n = F.col(name), count_of(name)
        if "rej" in name:
            inverse = ratio(F.lit(1.0), v)
            errors[name + suffix] = F.sqrt(ratio(inverse * (F.lit(1.0) - inverse), n)) * v * v
        elif "eff" in name or "acc" in name:
            errors[name + suffix] = F.sqrt(ratio(v * (F.lit(1.0) - v), n))
    return df.withColumns(errors)


def rejection_at_bin_efficiency(
    df: DataFrame, binning: Binning, score: str, label: str, targets: Sequence[float] = (0.5, 0.8), weight=None
) -> DataFrame:
    """Background rejection per bin with the signal efficiency fixed in each bin.

    The threshold of a bin is the smallest distinct score at or below which a
    share 1 - target of its signal weight lies; background above it passes.
    """
    binned = df.withColumn("bin", bin_right_closed(F.col(binning.variable), binning)).where(F.col("bin").isNotNull())
    scores = _by_score(binned, score, label, weight, ["bin"])
    sums = {"c_pos": F.col("w_pos"), "c_neg": F.col("w_neg")}
    points = running_totals(scores, score, sums, ["bin"], known_partitions=binning.n_bins)
    totals = scores.groupBy("bin").agg(F.sum("w_pos").alias("p"), F.sum("w_neg").alias("n"))
    joined = points.join(F.broadcast(totals), "bin")  # n_bins rows
    best = joined.groupBy("bin").agg(
        F.first("n").alias("n"),
        F.array(
            *[
                F.struct(
                    F.lit(float(t)).alias("target"),
                    F.min(
                        F.when(
                            F.col("c_pos") >= (1.0 - t) * F.col("p") - 1e-9 * F.col("p"),
                            F.struct(F.col(score).alias("threshold"), "c_neg"),
                        )
                    ).alias("b"),
                )
                for t in targets
            ]
        ).alias("points"),
    )
    return best.select("bin", "n", F.explode("points").alias("p")).select(
        "bin",
        F.col("p.target").alias("target"),
        F.col("p.b.threshold").alias("threshold"),
        ratio(F.col("n"), F.col("n") - F.col("p.b.c_neg")).alias("bkg_rejection"),
    )


# --------------------------------------------------------------- many classes


def one_against_background(
    df: DataFrame,
    scores: str,
    label: str,
    background: int,
    targets: Mapping[int, float],
    weight: str | None = None,
    num_thresholds: int = NUM_THRESHOLDS,
) -> DataFrame:
    """Rejection of each signal class against the background at its own working point.

    The score is s_sig / (s_sig + s_bkg) on rows of the two classes; classes
    with a working point of zero or less are skipped. Background rows are used
    by every class, signal rows by their own only.
    """
    wanted = {c: t for c, t in targets.items() if c != background and t > 0}
    signal = F.array(*[F.lit(c) for c in wanted])
    uses = F.when(F.col(label) == background, signal).otherwise(F.filter(signal, lambda c: c == F.col(label)))
    w = [weight] if weight else []
    rows = df.select(
        F.col(scores).alias("_scores"), F.col(label).alias("_label"), *w, F.explode(uses).alias("_class")
    )
    s_sig, s_bkg = F.get("_scores", F.col("_class")), F.get("_scores", F.lit(background))
    rows = rows.select(
        "_class", *w, ratio(s_sig, s_sig + s_bkg).alias("_s"), (F.col("_label") != background).cast("int").alias("_y")
    )
    table = threshold_table(rows, "_s", "_y", weight, ["_class"], num_thresholds)
    target = F.lit(None).cast("double")
    for c, t in wanted.items():
        target = F.when(F.col("_class") == c, F.lit(float(t))).otherwise(target)
    best = table.groupBy("_class").agg(_closest(F.col("tpr"), target).alias("b"))
    return best.select(
        F.col("_class").alias("class"),
        target.alias("working_point"),
        ratio(F.lit(1.0), F.lit(1.0) - F.col("b.tnr")).alias("rejection"),
        F.col("b.threshold").alias("threshold"),
    )


def multiclass_summary(df: DataFrame, scores: str, label: str, n_classes: int, num_thresholds: int = NUM_THRESHOLDS):
    """Categorical accuracy and the mean one-against-rest area over the classes."""
    accuracy = df.agg(F.avg((argmax(F.col(scores)) == F.col(label)).cast("double")).alias("accuracy"))
    rows = df.select(
        F.posexplode(F.slice(F.col(scores), 1, n_classes)).alias("_class", "_s"), F.col(label).alias("_label")
    ).select("_class", "_s", (F.col("_label") == F.col("_class")).cast("int").alias("_y"))
    areas = all_metrics(rows, "_s", "_y", by=["_class"], num_thresholds=num_thresholds)
    return areas.agg(F.avg("auc").alias("auc")).select(accuracy.scalar().alias("accuracy"), "auc")
