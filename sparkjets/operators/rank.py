"""Feature statistics, scaling and ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkjets.functions.binning import Binning, bin_clamped
from sparkjets.functions.numeric import ratio
from sparkjets.functions.random import uniform


def _as_rows(df: DataFrame, features: str) -> tuple[DataFrame, list[str]]:
    """One row per element of an array of feature structs (a NULL row for an empty array counts in no statistic)."""
    kind = df.schema[features].dataType if features in df.columns else df.select(features).schema[0].dataType
    element = kind.elementType if isinstance(kind, T.ArrayType) else kind
    column = F.explode_outer(features) if isinstance(kind, T.ArrayType) else F.col(features)
    return df.select(column.alias("f")), [f.name for f in element.fields]


def _long(row: DataFrame, names: Sequence[str], statistics: Sequence[str]) -> DataFrame:
    """A one-row table of ``<statistic>__<feature>`` columns as one row per feature."""
    items = [
        F.struct(F.lit(n).alias("feature"), *[F.col(f"`{s}__{n}`").alias(s) for s in statistics]) for n in names
    ]
    return row.select(F.explode(F.array(*items)).alias("i")).select("i.*")


def feature_moments(df: DataFrame, features: str) -> DataFrame:
    """Mean and population variance of every feature over all elements, in one pass: ``feature, mean, variance``."""
    rows, names = _as_rows(df, features)
    aggregates = []
    for n in names:
        x = F.col("f")[n].cast("double")
        aggregates += [F.avg(x).alias(f"mean__{n}"), F.var_pop(x).alias(f"variance__{n}")]
    return _long(rows.agg(*aggregates), names, ["mean", "variance"])


def feature_ranges(df: DataFrame, features: str) -> DataFrame:
    """Minimum and maximum of every feature over all elements: ``feature, lo, hi``."""
    rows, names = _as_rows(df, features)
    aggregates = []
    for n in names:
        x = F.col("f")[n].cast("double")
        aggregates += [F.min(x).alias(f"lo__{n}"), F.max(x).alias(f"hi__{n}")]
    return _long(rows.agg(*aggregates), names, ["lo", "hi"])


def _scaler_row(table: DataFrame, first: str, second: str) -> Column:
    pair = F.struct(F.col(first).alias("a"), F.col(second).alias("b"))
    return table.agg(F.map_from_entries(F.collect_list(F.struct("feature", pair)))).scalar()  # a row per feature


def _rescale(df: DataFrame, features: str, table: DataFrame, first: str, second: str, formula, out: str) -> DataFrame:
    kind = df.schema[features].dataType
    element = kind.elementType if isinstance(kind, T.ArrayType) else kind
    lookup = F.col("_scales")
    names = [f.name for f in element.fields]

    def scale(x: Column) -> Column:
        fields = []
        for n in names:
            pair = F.try_element_at(lookup, F.lit(n))
            fields.append(formula(x[n].cast("double"), pair["a"], pair["b"]).alias(n))
        return F.struct(*fields)

    scaled = F.transform(features, scale) if isinstance(kind, T.ArrayType) else scale(F.col(features))
    return df.withColumn("_scales", _scaler_row(table, first, second)).withColumn(out, scaled).drop("_scales")


def min_max_scale(df: DataFrame, features: str, ranges: DataFrame, out: str, low: float = 0.0, high: float = 1.0):
    """Scale features to ``[low, high]``; a feature without spread counts as one wide."""

    def formula(x, lo, hi):
        width = F.when(hi == lo, F.lit(1.0)).otherwise(hi - lo)
        return (x - lo) / width * (high - low) + low

    return _rescale(df, features, ranges, "lo", "hi", formula, out)


def standard_scale(df: DataFrame, features: str, moments: DataFrame, out: str) -> DataFrame:
    """Subtract the mean and divide by the standard deviation."""
    return _rescale(
        df, features, moments, "mean", "variance", lambda x, mean, variance: ratio(x - mean, F.sqrt(variance)), out
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, in one pass: ``a, b, corr``."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(*[F.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    cells = []
    for k, (a, b) in enumerate(pairs):
        for x, y in {(a, b), (b, a)}:
            cells.append(F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"c{k}").alias("corr")))
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def anova_f(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """One-way ANOVA F of every column between the label groups: ``variable, score``."""
    aggregates = [F.count(F.lit(1)).alias("n")]
    for c in columns:
        aggregates += [F.avg(c).alias(f"m__{c}"), (F.var_pop(c) * F.count(c)).alias(f"within__{c}")]
    groups = df.where(F.col(label).isNotNull()).groupBy(label).agg(*aggregates)
    # from here on one row per label
    totals = [F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")]
    for c in columns:
        grand = F.sum(F.col("n") * F.col(f"m__{c}")) / F.sum("n")
        square = F.sum(F.col("n") * F.col(f"m__{c}") * F.col(f"m__{c}"))
        totals.append((square - grand * grand * F.sum("n")).alias(f"between__{c}"))
        totals.append(F.sum(f"within__{c}").alias(f"within__{c}"))
    row = groups.agg(*totals)
    items = [
        F.struct(
            F.lit(c).alias("variable"),
            ratio(
                F.col(f"between__{c}") / (F.col("k") - 1), ratio(F.col(f"within__{c}"), F.col("n") - F.col("k"))
            ).alias("score"),
        )
        for c in columns
    ]
    return row.select(F.explode(F.array(*items)).alias("i")).select("i.*")


def mutual_information(df: DataFrame, binnings: Sequence[Binning], label: str) -> DataFrame:
    """Mutual information (nats) of every binned variable with the label: ``variable, score``.

    This is the plug-in estimate from joint counts, which one scan yields; the
    nearest-neighbour estimate needs all pairs of rows.
    """
    slots = [
        F.struct(F.lit(b.variable).alias("variable"), bin_clamped(F.col(b.variable), b).alias("bin")) for b in binnings
    ]
    joint = (
        df.where(F.col(label).isNotNull())
        .select(F.col(label).alias("y"), F.explode(F.array(*slots)).alias("s"))
        .groupBy(F.col("s.variable").alias("variable"), F.col("s.bin").alias("bin"), "y")
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
    )
    n_x = F.sum("n").over(Window.partitionBy("variable", "bin"))
    n_y = F.sum("n").over(Window.partitionBy("variable", "y"))
    n = F.sum("n").over(Window.partitionBy("variable"))
    parts = joint.withColumns({"n_x": n_x, "n_y": n_y, "all": n})
    term = F.col("n") / F.col("all") * F.log(F.col("n") * F.col("all") / (F.col("n_x") * F.col("n_y")))
    return parts.groupBy("variable").agg(F.sum(term).alias("score"))


def best_features(scores: DataFrame, k: int) -> DataFrame:
    """The ``k`` variables with the largest score."""
    return scores.orderBy(F.col("score").desc(), "variable").limit(k)


def noise_importance(
    df: DataFrame, features: Sequence[str], scorer, label: str, key: str, seed: int = 42, threshold: float = 0.5
) -> DataFrame:
    """Accuracy lost when one feature is replaced by uniform noise of the same mean and spread.

    ``scorer(columns: dict[str, Column]) -> Column``. All variants are scored in
    one scan; the noise is hashed from ``key``.
    """
    stats = df.agg(F.struct(*[F.struct(F.avg(f).alias("m"), F.stddev_pop(f).alias("s")).alias(f) for f in features]))
    spread = stats.scalar()
    plain = {f: F.col(f).cast("double") for f in features}

    def right(columns) -> Column:
        return F.avg(((scorer(columns) > threshold).cast("int") == F.col(label)).cast("double"))

    aggregates = [right(plain).alias("accuracy")]
    for f in features:
        half = F.lit(3.0**0.5) * spread[f]["s"]
        noise = spread[f]["m"] - half + uniform(key, F.lit(f), seed=seed) * half * 2
        aggregates.append(right({**plain, f: noise}).alias(f"without__{f}"))
    row = df.where(F.col(label).isNotNull()).agg(*aggregates)
    items = [
        F.struct(
            F.lit(f).alias("variable"),
            F.col(f"without__{f}").alias("noisy_accuracy"),
            (F.col("accuracy") - F.col(f"without__{f}")).alias("importance"),
        )
        for f in features
    ]
    long = row.select("accuracy", F.explode(F.array(*items)).alias("i")).select("accuracy", "i.*")
    return long.orderBy(F.col("importance").desc(), "variable")
