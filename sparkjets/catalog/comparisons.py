"""Lookups, and comparisons between models and generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkjets.catalog.aggregations import PT, PT_BIN_RIGHT
from sparkjets.catalog.base import R, query, r
from sparkjets.functions.binning import bin_right_closed
from sparkjets.operators import combine, compare, metrics
from sparkjets.plans.evaluation import by_model
from sparkjets.sources import tables

jets = tables.jets


@query(
    "sample_lookup",
    f"""SELECT jet_id, sample, {R('100e0 * (r_regionkey + 1)')} AS cross_section, {R('1e0 / (r_regionkey + 2)')} AS filt_eff
        FROM sampled JOIN region ON sample = r_name WHERE r_regionkey < 3""",
    ("sampled",),
)
def sample_lookup(spark, d):
    some = tables.samples(spark, d).where("cross_section < 400")
    out = combine.describe_samples(tables.jets_with_sample(spark, d), some, "sample", missing="drop")
    return out.select("jet_id", "sample", r("cross_section").alias("cross_section"), r("filt_eff").alias("filt_eff"))


@query(
    "samples_without_description",
    "SELECT DISTINCT sample FROM sampled JOIN region ON sample = r_name WHERE r_regionkey >= 3",
    ("sampled",),
)
def samples_without_description(spark, d):
    some = tables.samples(spark, d).where("cross_section < 400")
    return combine.missing_samples(tables.jets_with_sample(spark, d), some, "sample")


@query(
    "normalisation_lookup",
    f"SELECT sample, 'sum_w' AS norm_name, {R('sum(weight)')} AS norm FROM sampled GROUP BY sample",
    ("sampled",),
)
def normalisation_lookup(spark, d):
    out = combine.normalisation(tables.samples(spark, d), tables.metadata(spark, d))
    return out.select("sample", "norm_name", r("norm").alias("norm"))


@query(
    "quark_gluon_tables_joined",
    f"""WITH g AS (SELECT {PT_BIN_RIGHT} AS bin, label, sum(weight) AS weight, count(*) AS n FROM jets
            WHERE label IS NOT NULL GROUP BY 1, 2)
        SELECT q.bin, {R('q.weight')} AS weight_q, {R('g.weight')} AS weight_g, q.n AS n_q, g.n AS n_g
        FROM g q JOIN g ON q.bin = g.bin AND q.label = 1 AND g.label = 0""",
)
def quark_gluon_tables_joined(spark, d):
    df = jets(spark, d).where("label is not null").withColumn("bin", bin_right_closed(F.col("jets_pt"), PT))
    sums = df.groupBy("bin", "label").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))
    out = compare.merge_classes(sums, ["bin"], "label", ["weight", "n"])
    return out.withColumns({"weight_q": r("weight_q"), "weight_g": r("weight_g")})


# --------------------------------------------- metrics of models on generators

MODELS = {"A": (7919, 0.2), "B": (6271, 0.3), "C": (3571, 0.1)}
MODELS_SQL = " UNION ALL ".join(
    f"""SELECT '{m}' AS model, generator, label, weight, jets_pt, {1.0 - s!r}::DOUBLE * ((jet_id * {k}) % 10007)::DOUBLE / 10007e0
        + CASE WHEN label = 1 THEN {s!r}::DOUBLE ELSE 0e0 END AS score FROM jets WHERE label IS NOT NULL"""
    for m, (k, s) in MODELS.items()
)
TABLE = f"""models AS ({MODELS_SQL}), mt AS (SELECT model, generator, {PT_BIN_RIGHT} AS bin,
    sum(CASE WHEN label = 1 AND score > 0.5e0 THEN weight ELSE 0 END) / sum(CASE WHEN label = 1 THEN weight END) AS eff,
    sum(CASE WHEN (score > 0.5e0)::INT = label THEN weight ELSE 0 END) / sum(weight) AS acc
    FROM models GROUP BY 1, 2, 3)"""


def metric_table(spark, d):
    """Metrics per (model, generator, pt bin): all models in one scan of the jets."""
    df = jets(spark, d).where("label is not null")
    df = df.withColumns({f"score_{m}": tables.model_score(k, s) for m, (k, s) in MODELS.items()})
    df = df.withColumn("bin", bin_right_closed(F.col("jets_pt"), PT))
    long = by_model(df, {m: f"score_{m}" for m in MODELS}, ["generator", "label", "weight", "bin"])
    y, s, w = F.col("label"), F.col("score"), F.col("weight")
    return long.groupBy("model", "generator", "bin").agg(
        metrics.efficiency(y, s, w, 1, 0.5).alias("eff"), metrics.binary_accuracy(y, s, w).alias("acc")
    )


@query(
    "mean_metric_per_sample",
    f"WITH {TABLE} SELECT model, generator, {R('avg(eff)')} AS eff FROM mt WHERE bin > 1 GROUP BY model, generator",
)
def mean_metric_per_sample(spark, d):
    out = compare.mean_metric(metric_table(spark, d).where("bin > 1"), "eff", ["model", "generator"])
    return out.select("model", "generator", r("eff").alias("eff"))


@query(
    "ratio_to_nominal_sample",
    f"""WITH {TABLE}, a AS (SELECT model, generator, avg(eff) AS eff FROM mt GROUP BY 1, 2)
        SELECT a.model, a.generator, {R('a.eff')} AS eff, {R('n.eff')} AS eff_nominal, {R('a.eff / n.eff')} AS ratio
        FROM a JOIN a n ON a.model = n.model AND n.generator = 'F'""",
)
def ratio_to_nominal_sample(spark, d):
    means = compare.mean_metric(metric_table(spark, d), "eff", ["model", "generator"])
    out = compare.against_nominal(means, "eff", F.col("generator") == "F")
    return out.select("model", "generator", *[r(c).alias(c) for c in ("eff", "eff_nominal", "ratio")])


@query(
    "sample_dependence",
    f"""WITH {TABLE}, a AS (SELECT model, generator, avg(eff) AS eff FROM mt GROUP BY 1, 2)
        SELECT a.model, {R('1e0 - min(a.eff / n.eff)')} AS dependence, {R('any_value(n.eff)')} AS eff_nominal
        FROM a JOIN a n ON a.model = n.model AND n.generator = 'F' GROUP BY a.model""",
)
def sample_dependence(spark, d):
    means = compare.mean_metric(metric_table(spark, d), "eff", ["model", "generator"])
    out = compare.sample_dependence(means, "eff", F.col("generator") == "F")
    return out.select("model", r("dependence").alias("dependence"), r("eff_nominal").alias("eff_nominal"))


@query(
    "metric_matrix",
    f"""WITH {TABLE}, a AS (SELECT model, generator, avg(eff) AS eff FROM mt GROUP BY 1, 2)
        SELECT generator, {R("max(CASE WHEN model = 'A' THEN eff END)")} AS "A", {R("max(CASE WHEN model = 'B' THEN eff END)")} AS "B",
            {R("max(CASE WHEN model = 'C' THEN eff END)")} AS "C" FROM a GROUP BY generator""",
)
def metric_matrix(spark, d):
    means = compare.mean_metric(metric_table(spark, d), "eff", ["model", "generator"])
    out = compare.matrix(means, "generator", "model", list(MODELS), "eff")
    return out.select("generator", *[r(m).alias(m) for m in MODELS])


@query(
    "envelope_against_reference",
    f"""WITH {TABLE}, j AS (SELECT a.model, a.bin, abs(a.eff / n.eff - 1e0) AS q, abs(n.eff - a.eff) AS f FROM mt a
            JOIN mt n ON a.model = n.model AND a.bin = n.bin AND n.generator = 'F')
        SELECT model, bin, {R('avg(q)')} AS ratio_mean, {R('avg(f)')} AS diff_mean, {R('max(q)')} AS ratio_max, {R('max(f)')} AS diff_max
        FROM j GROUP BY model, bin""",
)
def envelope_against_reference(spark, d):
    table = metric_table(spark, d)
    out = compare.envelope(table, table.where("generator = 'F'"), "eff")
    return out.select("model", "bin", *[r(c).alias(c) for c in ("ratio_mean", "diff_mean", "ratio_max", "diff_max")])


@query(
    "largest_deviation",
    f"""WITH {TABLE} SELECT a.model, a.bin, {R('max(abs(1e0 - a.acc / n.acc))')} AS max_deviation FROM mt a
            JOIN mt n ON a.model = n.model AND a.bin = n.bin AND n.generator = 'F' GROUP BY a.model, a.bin""",
)
def largest_deviation(spark, d):
    table = metric_table(spark, d)
    out = compare.largest_deviation(table, table.where("generator = 'F'"), "acc", ["model", "bin"])
    return out.select("model", "bin", r("max_deviation").alias("max_deviation"))


@query(
    "generator_differences",
    f"""WITH {TABLE}, p AS (SELECT model, bin, max(CASE WHEN generator = 'F' THEN eff END) AS f, max(CASE WHEN generator = 'O' THEN eff END) AS o,
            max(CASE WHEN generator = 'P' THEN eff END) AS p FROM mt GROUP BY model, bin)
        SELECT model, bin, {R('(o - p) / f')} AS shower, {R('(f - p) / f')} AS hadronisation FROM p""",
)
def generator_differences(spark, d):
    out = compare.sample_differences(
        metric_table(spark, d), "eff", "generator", {"shower": ("O", "P"), "hadronisation": ("F", "P")}, "F", ["model", "bin"]
    )
    return out.select("model", "bin", r("shower").alias("shower"), r("hadronisation").alias("hadronisation"))


@query("mean_metric_per_model", f"WITH {TABLE} SELECT model, {R('avg(acc)')} AS acc FROM mt GROUP BY model")
def mean_metric_per_model(spark, d):
    return compare.mean_metric(metric_table(spark, d), "acc", ["model"]).select("model", r("acc").alias("acc"))


@query(
    "ratio_to_reference_model",
    f"""WITH {TABLE} SELECT a.model, a.generator, a.bin, {R('a.acc / n.acc')} AS ratio FROM mt a
        JOIN mt n ON a.generator = n.generator AND a.bin = n.bin AND n.model = 'A'""",
)
def ratio_to_reference_model(spark, d):
    out = compare.against_nominal(metric_table(spark, d), "acc", F.col("model") == "A", ["generator", "bin"])
    return out.select("model", "generator", "bin", r("ratio").alias("ratio"))


@query(
    "ratios_bound_by_bin",
    f"""WITH {TABLE} SELECT bin, {R("max(CASE WHEN generator = 'F' THEN eff END)")} AS "F", {R("max(CASE WHEN generator = 'O' THEN eff END)")} AS "O",
        {R("max(CASE WHEN generator = 'P' AND bin > 2 THEN eff END)")} AS "P" FROM mt WHERE model = 'A' GROUP BY bin""",
)
def ratios_bound_by_bin(spark, d):
    table = metric_table(spark, d).where("model = 'A'")
    parts = {g: table.where(F.col("generator") == g) for g in "FOP"}
    parts["P"] = parts["P"].where("bin > 2")
    return combine.bind_on(parts, "bin", "eff").select("bin", *[r(g).alias(g) for g in "FOP"])


@query(
    "model_ranking",
    f"""WITH {TABLE}, t AS (SELECT model, count(*) AS rows FROM models GROUP BY model), a AS (SELECT model, avg(acc) AS acc FROM mt GROUP BY model)
        SELECT model, rows, {R('acc')} AS acc FROM t JOIN a USING (model) ORDER BY acc DESC LIMIT 2""",
)
def model_ranking(spark, d):
    table = metric_table(spark, d)
    long = jets(spark, d).where("label is not null").select(F.explode(F.array(*[F.lit(m) for m in MODELS])).alias("model"))
    technical = long.groupBy("model").agg(F.count("*").alias("rows"))
    out = compare.model_ranking(technical, compare.mean_metric(table, "acc", ["model"]), "acc", top=2)
    return out.select("model", "rows", r("acc").alias("acc"))
