"""Binnings, histograms, counts, weights and the flagship query."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkjets.catalog.base import R, case_bins, query, r
from sparkjets.functions.binning import (
    Binning,
    bin_clamped,
    bin_joint,
    bin_right_closed,
    bin_with_class,
    class_split,
)
from sparkjets.functions.labels import GLUON, QUARKS
from sparkjets.functions.lang import row_query
from sparkjets.operators import combine, hist, nested, weights
from sparkjets.plans import flatten_resample
from sparkjets.sources import tables

jets = tables.jets

# Edges lie off the two-decimal grid of the prices.
PT = Binning("jets_pt", [1000.005, 50000.005, 100000.005, 150000.005, 200000.005, 300000.005, 400000.005, 500000.005])
PT_UNIFORM = Binning("jets_pt", 20, 50000.003, 450000.003)
PT_LOG = Binning("jets_pt", 10, 1000.005, 500000.005, 10)
ETA = Binning("jets_eta", [-4.505, -2.105, -0.805, 0.805, 2.105, 4.505])
SCORE = Binning("score", 16, 0.0000001, 1.0000001)

PT_BIN = case_bins("jets_pt", PT.edges)
PT_BIN_RIGHT = case_bins("jets_pt", PT.edges, right_closed=True)
ETA_BIN = case_bins("jets_eta", ETA.edges)
CLASS_BIN = f"""(CASE WHEN parton BETWEEN 1 AND 6 THEN {PT_BIN} WHEN parton = 21 THEN {PT_BIN} + {PT.n_bins} ELSE 0 END)::INT"""


def pt_bin():
    return bin_clamped(F.col("jets_pt"), PT)


def frame_sql(binning: Binning) -> str:
    """The bins of a binning as SQL rows ``(variable, bin, bin_lo, bin_hi)``."""
    rows = ", ".join(
        f"('{binning.variable}', {i}, {lo!r}::DOUBLE, {hi!r}::DOUBLE)"
        for i, (lo, hi) in enumerate(zip(binning.edges, binning.edges[1:]))
    )
    return f"(SELECT * FROM (VALUES {rows}) v(variable, bin, bin_lo, bin_hi))"


# ------------------------------------------------------------------ binnings


@query("bin_clamped_edges", f"SELECT jet_id, {PT_BIN} AS bin FROM jets")
def bin_clamped_edges(spark, d):
    return jets(spark, d).select("jet_id", pt_bin().alias("bin"))


def missing_values(df):
    """Jets whose pt is NULL or NaN for some ids."""
    holed = F.when(F.col("jet_id") % 7 == 0, F.lit(None)).when(F.col("jet_id") % 11 == 0, F.lit(float("nan")))
    return df.withColumn("jets_pt", F.when((F.col("jet_id") % 7 == 0) | (F.col("jet_id") % 11 == 0), holed).otherwise(F.col("jets_pt")))


MISSING = "CASE WHEN jet_id % 7 = 0 OR jet_id % 11 = 0 THEN NULL"


@query(
    "bins_of_missing_values",
    f"""SELECT jet_id, {MISSING} ELSE {PT_BIN} END::INT AS bin, {MISSING} ELSE {case_bins('jets_pt', PT_UNIFORM.edges)} END::INT
            AS uniform_bin, {MISSING} ELSE {PT_BIN_RIGHT} END::INT AS right_closed FROM jets""",
)
def bins_of_missing_values(spark, d):
    """NULL and NaN have no bin, whatever the kind of edges."""
    df = missing_values(jets(spark, d))
    return df.select(
        "jet_id",
        pt_bin().alias("bin"),
        bin_clamped(F.col("jets_pt"), PT_UNIFORM).alias("uniform_bin"),
        bin_right_closed(F.col("jets_pt"), PT).alias("right_closed"),
    )


@query(
    "histogram_of_missing_values",
    f"""SELECT f.bin::INT AS bin, {R('coalesce(sum(weight), 0e0)', 3)} AS value FROM {frame_sql(PT_UNIFORM)} f
        LEFT JOIN (SELECT weight, {case_bins('jets_pt', PT_UNIFORM.edges)} AS bin FROM jets
            WHERE jet_id % 7 <> 0 AND jet_id % 11 <> 0) j ON f.bin = j.bin GROUP BY f.bin""",
)
def histogram_of_missing_values(spark, d):
    out = hist.histogram(missing_values(jets(spark, d)), PT_UNIFORM, "weight")
    return out.select("bin", r("value", 3).alias("value"))


@query(
    "bin_uniform_and_log",
    f"""SELECT jet_id, {case_bins('jets_pt', PT_UNIFORM.edges)} AS uniform_bin, {case_bins('jets_pt', PT_LOG.edges)} AS log_bin
        FROM jets""",
)
def bin_uniform_and_log(spark, d):
    pt = F.col("jets_pt")
    return jets(spark, d).select(
        "jet_id", bin_clamped(pt, PT_UNIFORM).alias("uniform_bin"), bin_clamped(pt, PT_LOG).alias("log_bin")
    )


@query(
    "bin_right_closed_intervals",
    f"SELECT jet_id, {case_bins('jets_pt', PT.edges[1:-1], right_closed=True)} AS bin FROM jets",
)
def bin_right_closed_intervals(spark, d):
    inner = Binning("jets_pt", PT.edges[1:-1])
    return jets(spark, d).select("jet_id", bin_right_closed(F.col("jets_pt"), inner).alias("bin"))


@query("bin_with_class_offset", f"SELECT jet_id, {CLASS_BIN} AS bin FROM jets")
def bin_with_class_offset(spark, d):
    index = bin_with_class(pt_bin(), PT.n_bins, F.col("parton"), QUARKS, GLUON)
    return jets(spark, d).select("jet_id", index.alias("bin"))


@query("bin_two_variables", f"SELECT jet_id, ({PT_BIN} * {ETA.n_bins} + {ETA_BIN})::INT AS bin FROM jets")
def bin_two_variables(spark, d):
    joint = bin_joint(pt_bin(), bin_clamped(F.col("jets_eta"), ETA), ETA.n_bins)
    return jets(spark, d).select("jet_id", joint.alias("bin"))


@query(
    "bin_two_variables_with_class",
    f"""WITH b AS (SELECT jet_id, parton, {PT_BIN} * {ETA.n_bins} + {ETA_BIN} AS joint FROM jets)
        SELECT jet_id, (CASE WHEN parton BETWEEN 1 AND 6 THEN joint WHEN parton = 21 THEN joint + {PT.n_bins * ETA.n_bins}
            ELSE 0 END)::INT AS bin FROM b""",
)
def bin_two_variables_with_class(spark, d):
    cells = PT.n_bins * ETA.n_bins
    joint = bin_joint(pt_bin(), bin_clamped(F.col("jets_eta"), ETA), ETA.n_bins)
    return jets(spark, d).select("jet_id", bin_with_class(joint, cells, F.col("parton"), QUARKS, GLUON).alias("bin"))


@query("class_split_flag", "SELECT jet_id, (parton BETWEEN 1 AND 6)::INT AS flag FROM jets")
def class_split_flag(spark, d):
    return jets(spark, d).select("jet_id", class_split(F.col("parton"), QUARKS, GLUON).alias("flag"))


@query(
    "bin_table",
    f"""SELECT f.bin, {R('bin_lo')} AS bin_lo, {R('bin_hi')} AS bin_hi, {R('(bin_lo + bin_hi) / 2')} AS bin_mid,
        {R('bin_hi - bin_lo')} AS bin_width, coalesce(n, 0) AS n FROM {frame_sql(PT_LOG)} f
        LEFT JOIN (SELECT {case_bins('jets_pt', PT_LOG.edges)} AS bin, count(*) AS n FROM jets GROUP BY 1) c ON f.bin = c.bin""",
)
def bin_table(spark, d):
    counts = jets(spark, d).groupBy(bin_clamped(F.col("jets_pt"), PT_LOG).alias("bin")).agg(F.count("*").alias("n"))
    table = PT_LOG.table(spark).join(counts, "bin", "left").na.fill(0, ["n"])
    return table.select("bin", *[r(c).alias(c) for c in ("bin_lo", "bin_hi", "bin_mid", "bin_width")], "n")


@query(
    "per_bin_value_lookup",
    f"""WITH v AS (SELECT {PT_BIN} AS bin, avg(score) AS value FROM jets GROUP BY 1)
        SELECT jet_id, v.bin, {R('value')} AS value FROM (SELECT jet_id, {PT_BIN} AS bin FROM jets) j JOIN v USING (bin)""",
)
def per_bin_value_lookup(spark, d):
    df = jets(spark, d).withColumn("bin", pt_bin())
    values = df.groupBy("bin").agg(F.avg("score").alias("value"))
    return df.select("jet_id", "bin").join(F.broadcast(values), "bin").select("jet_id", "bin", r("value").alias("value"))


@query(
    "bin_mid_and_width_scaled",
    f"""SELECT bin, {R('(bin_lo + bin_hi) / 2 * 1e-3', 7)} AS mid_gev, {R('(bin_hi - bin_lo) * 1e-3', 5)} AS width_gev, n
        FROM {frame_sql(PT)} f JOIN (SELECT {PT_BIN_RIGHT} AS bin, count(*) AS n FROM jets GROUP BY 1) c USING (bin)""",
)
def bin_mid_and_width_scaled(spark, d):
    counts = jets(spark, d).groupBy(bin_right_closed(F.col("jets_pt"), PT).alias("bin")).agg(F.count("*").alias("n"))
    return (
        PT.table(spark)
        .join(counts, "bin")
        .select("bin", r(F.col("bin_mid") * 1e-3, 7).alias("mid_gev"), r(F.col("bin_width") * 1e-3, 5).alias("width_gev"), "n")
    )


# ----------------------------------------------------------- counts, histograms


@query(
    "count_per_bin",
    f"""SELECT f.bin, coalesce(n, 0) AS n FROM {frame_sql(PT)} f
        LEFT JOIN (SELECT {PT_BIN} AS bin, count(*) AS n FROM jets GROUP BY 1) c ON f.bin = c.bin""",
)
def count_per_bin(spark, d):
    return hist.count_per_bin(jets(spark, d), pt_bin(), PT.n_bins)


def _hist_sql(binning: Binning, weight: str) -> str:
    return f"""SELECT f.variable, f.bin, {R('f.bin_lo')} AS bin_lo, {R('coalesce(v, 0e0)', 3)} AS value
        FROM {frame_sql(binning)} f LEFT JOIN (SELECT {case_bins(binning.variable, binning.edges)} AS bin, sum({weight}) AS v
        FROM jets GROUP BY 1) c ON f.bin = c.bin"""


@query("weighted_histogram", f"SELECT bin, bin_lo, value FROM ({_hist_sql(PT_UNIFORM, 'weight')})")
def weighted_histogram(spark, d):
    h = hist.histogram(jets(spark, d), PT_UNIFORM, "weight")
    return h.select("bin", r("bin_lo").alias("bin_lo"), r("value", 3).alias("value"))


@query(
    "many_histograms_one_pass",
    " UNION ALL ".join(_hist_sql(b, "weight") for b in (PT, ETA, SCORE)),
)
def many_histograms_one_pass(spark, d):
    h = hist.histogram_multiple(jets(spark, d), [PT, ETA, SCORE], "weight")
    return h.select("variable", "bin", r("bin_lo").alias("bin_lo"), r("value", 3).alias("value"))


@query("sum_of_weights", f"SELECT {R('sum(weight)')} AS w, {R('sum(jets_pt * weight)', 1)} AS pt_w FROM jets")
def sum_of_weights(spark, d):
    return jets(spark, d).agg(r(F.sum("weight")).alias("w"), r(F.sum(F.col("jets_pt") * F.col("weight")), 1).alias("pt_w"))


@query(
    "weighted_fraction_above_limit",
    f"""WITH n AS (SELECT jet_id, count(*) AS n FROM cons GROUP BY jet_id)
        SELECT {R('sum(CASE WHEN n > 5 THEN weight ELSE 0 END)')} AS selected, {R('sum(weight)')} AS total,
            {R('sum(CASE WHEN n > 5 THEN weight ELSE 0 END) / sum(weight)')} AS fraction FROM jets JOIN n USING (jet_id)""",
    ("jets", "cons"),
)
def weighted_fraction_above_limit(spark, d):
    counts = tables.constituents(spark, d).groupBy("jet_id").agg(F.count("*").alias("n"))
    df = jets(spark, d).join(counts, "jet_id")
    out = hist.weighted_fraction(df, row_query(df, "n > 5"), "weight")
    return out.select(*[r(c).alias(c) for c in out.columns])


@query(
    "unmatched_jets_report",
    f"""SELECT slice, count(*) AS jets, count(CASE WHEN parton NOT IN (1, 2, 3, 21, -1) THEN 1 END) AS unmatched,
            count(CASE WHEN parton = -1 THEN 1 END) AS pileup,
            {R('count(CASE WHEN parton NOT IN (1, 2, 3, 21, -1) THEN 1 END)::DOUBLE / count(*)')} AS unmatched_fraction,
            {R('count(CASE WHEN parton = -1 THEN 1 END)::DOUBLE / count(*)')} AS pileup_fraction
        FROM jets WHERE jets_pt > 20000e0 AND jets_pt < 2500000e0 AND jets_eta > -2.1e0 AND jets_eta < 2.1e0
        GROUP BY ROLLUP (slice)""",
)
def unmatched_jets_report(spark, d):
    df = jets(spark, d)
    accepted = row_query(df, "20_000 < jets_pt < 2_500_000 and -2.1 < jets_eta < 2.1")
    out = hist.unmatched_report(df, "slice", "parton", accepted, [1, 2, 3, 21])
    return out.withColumns({c: r(c) for c in ("unmatched_fraction", "pileup_fraction")})


@query(
    "combined_metadata",
    f"""SELECT 'sum_w' AS key, {R('sum(weight)')} AS value FROM sampled
        UNION ALL SELECT 'num_events', count(*)::DOUBLE FROM sampled""",
    ("sampled",),
)
def combined_metadata(spark, d):
    out = combine.combine_metadata(tables.metadata(spark, d))
    return out.select("key", r("value").alias("value"))


@query(
    "effective_event_counts",
    f"""SELECT slice, {R('sum(weight)*sum(weight)/sum(weight*weight)')} AS n_eff,
        {R('sum(CASE WHEN label=1 THEN weight END)*sum(CASE WHEN label=1 THEN weight END)/sum(CASE WHEN label=1 THEN weight*weight END)')} AS n_eff_q,
        {R('sum(CASE WHEN label=0 THEN weight END)*sum(CASE WHEN label=0 THEN weight END)/sum(CASE WHEN label=0 THEN weight*weight END)')} AS n_eff_g
        FROM jets GROUP BY slice""",
)
def effective_event_counts(spark, d):
    from sparkjets.operators.metrics import effective_events

    w, y = F.col("weight"), F.col("label")
    return jets(spark, d).groupBy("slice").agg(
        r(effective_events(w)).alias("n_eff"),
        r(effective_events(w, y == 1)).alias("n_eff_q"),
        r(effective_events(w, y == 0)).alias("n_eff_g"),
    )


@query(
    "quark_gluon_ratio",
    f"""WITH s AS (SELECT {PT_BIN_RIGHT} AS bin, sum(CASE WHEN label = 1 THEN weight END) AS wq,
            sqrt(sum(CASE WHEN label = 1 THEN weight*weight END)) AS eq, sum(CASE WHEN label = 0 THEN weight END) AS wg,
            sqrt(sum(CASE WHEN label = 0 THEN weight*weight END)) AS eg FROM jets GROUP BY 1)
        SELECT bin, {R('wq / wg')} AS frac, {R('wq / wg * sqrt((eq/wq)*(eq/wq) + (eg/wg)*(eg/wg))')} AS frac_err FROM s""",
)
def quark_gluon_ratio(spark, d):
    df = jets(spark, d).withColumn("bin", bin_right_closed(F.col("jets_pt"), PT))
    out = hist.quark_gluon_ratio(df, "bin", "label", "weight")
    return out.select("bin", r("frac").alias("frac"), r("frac_err").alias("frac_err"))


@query(
    "class_probability_histograms",
    " UNION ALL ".join(
        f"""SELECT variable, label, bin, {R('v / sum(v) OVER (PARTITION BY label)')} AS probability FROM (SELECT
        '{b.variable}' AS variable, label, {case_bins(b.variable, b.edges)} AS bin, sum(weight) AS v FROM jets
        WHERE label IS NOT NULL GROUP BY 2, 3)"""
        for b in (PT, ETA)
    ),
)
def class_probability_histograms(spark, d):
    df = jets(spark, d).where("label is not null")
    out = hist.class_histograms(df, [PT, ETA], "label", "weight")
    return out.select("variable", "label", "bin", r("probability").alias("probability"))


@query(
    "class_histogram_of_constituents",
    f"""WITH c AS (SELECT label, {case_bins('pt', [0.0, 20000.005, 40000.005, 60000.005, 200000.0])} AS bin, count(*) AS n
            FROM lead JOIN jets USING (jet_id) WHERE label IS NOT NULL GROUP BY 1, 2)
        SELECT label, bin, {R('n / sum(n) OVER (PARTITION BY label)')} AS probability FROM c""",
    ("lead", "jets"),
)
def class_histogram_of_constituents(spark, d):
    df = tables.jets_nested(spark, d).where("label is not null").select("label", F.col("jets_Constituent_pt").alias("pt"))
    flat = nested.explode_to_scalars(df, ["pt"])
    out = hist.class_histograms(flat, [Binning("pt", [0.0, 20000.005, 40000.005, 60000.005, 200000.0])], "label")
    return out.select("label", "bin", r("probability").alias("probability"))


@query(
    "histogram_by_hue_density",
    f"""WITH h AS (SELECT generator, {case_bins('jets_pt', PT_LOG.edges)} AS bin, sum(weight) AS v FROM jets GROUP BY 1, 2)
        SELECT generator, h.bin, {R('v / sum(v) OVER () / (bin_hi - bin_lo) * 1e6')} AS density
        FROM h JOIN {frame_sql(PT_LOG)} f ON h.bin = f.bin""",
)
def histogram_by_hue_density(spark, d):
    out = hist.histogram_by(jets(spark, d), PT_LOG, ["generator"], "weight", "density", common_norm=True)
    return out.select("generator", "bin", r(F.col("value") * 1e6).alias("density"))


@query(
    "share_within_hue",
    f"""WITH h AS (SELECT generator, {PT_BIN} AS bin, count(*) AS v FROM jets GROUP BY 1, 2)
        SELECT generator, bin, {R('v / sum(v) OVER (PARTITION BY generator)')} AS share FROM h""",
)
def share_within_hue(spark, d):
    out = hist.histogram_by(jets(spark, d), PT, ["generator"], None, "probability")
    return out.select("generator", "bin", r("value").alias("share"))


@query("column_range", f"SELECT {R('min(jets_pt)')} AS lo, {R('max(jets_pt)')} AS hi FROM jets WHERE label IS NOT NULL")
def column_range(spark, d):
    return jets(spark, d).where("label is not null").agg(r(F.min("jets_pt")).alias("lo"), r(F.max("jets_pt")).alias("hi"))


@query("row_count", "SELECT count(*) AS n FROM orders", ())
def row_count(spark, d):
    return tables.table(spark, d, "orders").agg(F.count(F.lit(1)).alias("n"))


@query(
    "edges_of_flattened_spectrum",
    """WITH s AS (SELECT weight, min(jets_pt * 1e-6) AS edge FROM jets WHERE parton = 21 GROUP BY weight),
        t AS (SELECT weight, max(jets_pt * 1e-6) AS edge FROM jets WHERE parton <> 21 GROUP BY weight)
        SELECT DISTINCT round(edge + 1e-6, 3) + 0e0 AS edge FROM (SELECT edge FROM s UNION ALL
            SELECT edge FROM (SELECT edge FROM t ORDER BY weight DESC LIMIT 1))""",
)
def edges_of_flattened_spectrum(spark, d):
    return hist.weight_bin_edges(jets(spark, d), "jets_pt", "weight", "parton", 1e-6)


@query(
    "running_totals_over_slices",
    f"""WITH s AS (SELECT slice, count(*) AS n, sum(weight) AS w FROM jets GROUP BY slice)
        SELECT slice, sum(n) OVER (ORDER BY slice)::BIGINT AS n, {R('sum(w) OVER (ORDER BY slice)')} AS w FROM s""",
)
def running_totals_over_slices(spark, d):
    from sparkjets.operators.ordered import running_totals

    s = jets(spark, d).groupBy("slice").agg(F.count("*").alias("c"), F.sum("weight").alias("w_slice"))
    out = running_totals(s, "slice", {"n": F.col("c"), "w": F.col("w_slice")})
    return out.select("slice", "n", r("w").alias("w"))


# -------------------------------------------------------------------- weights


@query(
    "flat_weight_per_bin",
    f"""WITH c AS (SELECT {PT_BIN} AS bin, count(*) AS n FROM jets GROUP BY 1)
        SELECT bin, n, {R('(1e0 / n) / (SELECT sum(1e0 / n) FROM c)', 9)} AS w FROM c""",
)
def flat_weight_per_bin(spark, d):
    out = weights.flat_weights(jets(spark, d).withColumn("b", pt_bin()), "b", PT.n_bins)
    return out.select("bin", "n", r("w", 9).alias("w"))


@query(
    "flat_weight_total_norm",
    f"""WITH c AS (SELECT {PT_BIN} AS bin, count(*) AS n FROM jets GROUP BY 1),
        w AS (SELECT bin, (1e0 / n) / (SELECT sum(1e0 / n) FROM c) * (SELECT sum(n) FROM c) AS w FROM c)
        SELECT jet_id, {R('w')} AS flat FROM (SELECT jet_id, {PT_BIN} AS bin FROM jets) JOIN w USING (bin)""",
)
def flat_weight_total_norm(spark, d):
    out = weights.add_flat_weight(jets(spark, d).withColumn("b", pt_bin()), "b", PT.n_bins, "flat", "total")
    return out.select("jet_id", r("flat").alias("flat"))


PHYS = """WITH norm AS (SELECT sample, sum(weight) AS norm FROM sampled GROUP BY sample),
    d AS (SELECT r_name AS sample, 100e0 * (r_regionkey + 1) AS xs, 1e0 / (r_regionkey + 2) AS eff FROM region),
    p AS (SELECT s.*, s.weight * 139000e0 * xs * eff / norm AS phys FROM sampled s JOIN d USING (sample) JOIN norm USING (sample))"""


@query("physical_weight", f"{PHYS} SELECT jet_id, sample, {R('phys', 4)} AS weight FROM p", ("sampled",))
def physical_weight(spark, d):
    out = flatten_resample.physical_spectrum(
        tables.jets_with_sample(spark, d), tables.samples(spark, d), tables.metadata(spark, d)
    )
    return out.select("jet_id", "sample", r("weight", 4).alias("weight"))


@query(
    "physical_spectrum_histogram",
    f"""{PHYS} SELECT sample, {PT_BIN} AS bin, {R('sum(phys)', 2)} AS value FROM p
        WHERE jets_pt < 1.4e0 * [100e3, 200e3, 300e3, 400e3, 500e3][slice] AND phys > 0e0 GROUP BY 1, 2""",
    ("sampled",),
)
def physical_spectrum_histogram(spark, d):
    out = flatten_resample.physical_spectrum(
        tables.jets_with_sample(spark, d),
        tables.samples(spark, d),
        tables.metadata(spark, d),
        slice_column="slice",
        slice_upper=[1e5, 2e5, 3e5, 4e5, 5e5],
        weight_limits=(0.0, None),
    )
    h = hist.histogram_by(out, PT, ["sample"], "weight")
    return h.select("sample", "bin", r("value", 2).alias("value"))


@query(
    "renormalised_weights",
    f"SELECT jet_id, {R('weight / (SELECT avg(weight) FROM jets)')} AS weight FROM jets",
)
def renormalised_weights(spark, d):
    return weights.renormalise(jets(spark, d), "weight").select("jet_id", r("weight").alias("weight"))


@query(
    "weight_over_dataset_norm",
    f"SELECT jet_id, {R('weight / [2e0, 4e0, 5e0, 8e0, 10e0][slice]')} AS weight FROM jets",
)
def weight_over_dataset_norm(spark, d):
    out = weights.divide_by_norm(jets(spark, d), "weight", F.col("slice") - 1, [2, 4, 5, 8, 10])
    return out.select("jet_id", r("weight").alias("weight"))


@query("systematic_weight_shift", f"SELECT jet_id, {R('weight * ((weight * 1.1e0) / weight)')} AS weight FROM jets")
def systematic_weight_shift(spark, d):
    from sparkjets.functions.augment import shift_weights

    return shift_weights(jets(spark, d), "jet_id", "weight_mc", indices=1).select("jet_id", r("weight").alias("weight"))


# ------------------------------------------------------------------- flagship


@query(
    "flat_spectrum_histogram",
    f"""WITH f AS (SELECT jet_id, jets_pt, parton, label, {CLASS_BIN} AS cbin, {PT_BIN} AS bin FROM ejets
            WHERE jets_pt > 10000e0 AND jets_eta > -2.1e0 AND jets_eta < 2.1e0 AND parton <> -1),
        c AS (SELECT cbin, count(*) AS n FROM f GROUP BY cbin),
        w AS (SELECT cbin, (1e0 / n) / (SELECT sum(1e0 / n) FROM c) AS w FROM c)
        SELECT label, bin, count(*) AS jets, {R('sum(w)')} AS weight FROM f JOIN w USING (cbin) GROUP BY label, bin""",
    ("ejets",),
)
def flat_spectrum_histogram(spark, d):
    """Flatten with cuts, count per (class, bin), weight flat, histogram per class: every bin ends equal."""
    jets_flat = flatten_resample.flat_spectrum(
        tables.events_nested(spark, d),
        PT,
        "jets_parton",
        "jets_id",
        cuts={"jets_pt": (10_000.0, None), "jets_eta": (-2.1, 2.1)},
        drop=["vertex_id"],
    )
    from sparkjets.functions.labels import quark_gluon

    return (
        jets_flat.groupBy(quark_gluon(F.col("jets_parton")).cast("int").alias("label"), pt_bin().alias("bin"))
        .agg(F.count("*").alias("jets"), F.sum("weight_flat").alias("w"))
        .select("label", "bin", "jets", r("w").alias("weight"))
    )
