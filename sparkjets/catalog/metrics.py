"""Tagging metrics over scored jets."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkjets.catalog.aggregations import ETA, PT, PT_BIN_RIGHT
from sparkjets.catalog.base import R, case_bins, query, r
from sparkjets.functions import labels
from sparkjets.functions.binning import Binning
from sparkjets.functions.lang import row_query
from sparkjets.operators import metrics
from sparkjets.plans import evaluation
from sparkjets.sources import io, tables

jets = tables.jets


def scan_sql(by: str = "", weight: str = "weight", source: str = "jets", score: str = "score", label: str = "label"):
    """CTE text: the threshold scan done literally, every row against every threshold."""
    keys = f"{by}, " if by else ""
    return f"""scan AS (SELECT {keys}idx, t,
        sum(CASE WHEN {label} = 1 AND {score} > t THEN {weight} ELSE 0e0 END) / nullif(sum(CASE WHEN {label} = 1 THEN {weight} END), 0) AS tpr,
        sum(CASE WHEN {label} = 0 AND {score} <= t THEN {weight} ELSE 0e0 END) / nullif(sum(CASE WHEN {label} = 0 THEN {weight} END), 0) AS tnr
        FROM {source}, thr GROUP BY {keys}idx, t)"""


def best_sql(fixed: str, target: float, by: str = "") -> str:
    """CTE text: the first threshold whose fixed efficiency is nearest to the target."""
    part = f"PARTITION BY {by} " if by else ""
    return f"""best AS (SELECT * FROM (SELECT *, row_number() OVER ({part}ORDER BY ({fixed} - {target!r}::DOUBLE)
        * ({fixed} - {target!r}::DOUBLE), idx) AS nth FROM scan WHERE {fixed} IS NOT NULL) WHERE nth = 1)"""


def known(spark, d):
    return jets(spark, d).where("label is not null")


@query(
    "binary_accuracy",
    f"SELECT {R('sum(CASE WHEN (score > 0.5e0)::INT = label THEN weight ELSE 0 END) / sum(weight)')} AS accuracy "
    "FROM jets WHERE label IS NOT NULL",
)
def binary_accuracy(spark, d):
    return known(spark, d).agg(
        r(metrics.binary_accuracy(F.col("label"), F.col("score"), F.col("weight"))).alias("accuracy")
    )


EFF = {
    1: "sum(CASE WHEN label = 1 AND score > 0.6e0 THEN weight ELSE 0 END) / sum(CASE WHEN label = 1 THEN weight END)",
    0: "sum(CASE WHEN label = 0 AND score <= 0.6e0 THEN weight ELSE 0 END) / sum(CASE WHEN label = 0 THEN weight END)",
}


@query("efficiency_at_threshold", f"SELECT slice, {R(EFF[1])} AS quark, {R(EFF[0])} AS gluon FROM jets GROUP BY slice")
def efficiency_at_threshold(spark, d):
    y, s, w = F.col("label"), F.col("score"), F.col("weight")
    return jets(spark, d).groupBy("slice").agg(
        r(metrics.efficiency(y, s, w, 1, 0.6)).alias("quark"), r(metrics.efficiency(y, s, w, 0, 0.6)).alias("gluon")
    )


@query(
    "rejection_at_threshold",
    f"SELECT slice, {R(f'1e0 / (1e0 - {EFF[1]})')} AS quark, {R(f'1e0 / (1e0 - {EFF[0]})')} AS gluon FROM jets GROUP BY slice",
)
def rejection_at_threshold(spark, d):
    y, s, w = F.col("label"), F.col("score"), F.col("weight")
    return jets(spark, d).groupBy("slice").agg(
        r(metrics.rejection(y, s, w, 1, 0.6)).alias("quark"), r(metrics.rejection(y, s, w, 0, 0.6)).alias("gluon")
    )


@query(
    "rejection_at_efficiency",
    f"WITH {scan_sql()}, {best_sql('tpr', 0.7)} SELECT {R('1e0 / tnr')} AS rejection, {R('t')} AS threshold FROM best",
    ("jets", "thr"),
)
def rejection_at_efficiency(spark, d):
    out = metrics.rejection_at_efficiency(jets(spark, d), "score", "label", 0.7, 1, "weight")
    return out.select(r("rejection").alias("rejection"), r("threshold").alias("threshold"))


@query(
    "effective_tagging_efficiency",
    f"""WITH b AS (SELECT slice, {case_bins('abs(2 * score - 1)', [float(x) for x in metrics.DILUTION_BINS], right_closed=True)} AS bin,
            ((score > 0.5e0)::INT <> label)::INT AS wrong FROM jets WHERE label IS NOT NULL),
        g AS (SELECT slice, bin, count(*) AS n, sum(wrong) AS bad FROM b WHERE bin IS NOT NULL GROUP BY slice, bin)
        SELECT slice, {R('sum(n * (1 - 2e0 * bad / n) * (1 - 2e0 * bad / n)) / sum(n)')} AS effective_tagging_efficiency
        FROM g GROUP BY slice""",
)
def effective_tagging_efficiency(spark, d):
    out = metrics.effective_tagging_efficiency(known(spark, d), "score", "label", by=["slice"])
    return out.select("slice", r("effective_tagging_efficiency").alias("effective_tagging_efficiency"))


@query(
    "threshold_scan",
    f"WITH {scan_sql('slice')} SELECT slice, idx, {R('t')} AS threshold, {R('tpr')} AS tpr, {R('tnr')} AS tnr FROM scan",
    ("jets", "thr"),
)
def threshold_scan(spark, d):
    out = metrics.threshold_table(jets(spark, d), "score", "label", "weight", ["slice"])
    return out.select("slice", "idx", *[r(c).alias(c) for c in ("threshold", "tpr", "tnr")])


@query(
    "metrics_at_fixed_working_point",
    f"""WITH {scan_sql('slice')}, {best_sql('tnr', 0.8, 'slice')} SELECT slice, {R('tpr')} AS efficiency,
        {R('1e0 / nullif(1e0 - tpr, 0)')} AS rejection, {R('t')} AS threshold FROM best""",
    ("jets", "thr"),
)
def metrics_at_fixed_working_point(spark, d):
    out = metrics.at_working_point(
        jets(spark, d), "score", "label", 0.8, fixed_label=0, returned_label=1, weight="weight", by=["slice"]
    )
    return out.select("slice", *[r(c).alias(c) for c in ("efficiency", "rejection", "threshold")])


@query(
    "rejection_curve",
    f"""WITH {scan_sql()}, u AS (SELECT tpr, min(idx) AS idx FROM scan WHERE tpr > 0.04e0 GROUP BY tpr)
        SELECT {R('u.tpr')} AS sig_eff, {R('1e0 / nullif(1e0 - tnr, 0)')} AS bkg_rej FROM u JOIN scan USING (idx)""",
    ("jets", "thr"),
)
def rejection_curve(spark, d):
    out = metrics.rejection_curve(jets(spark, d), "score", "label", "weight")
    return out.select(r("sig_eff").alias("sig_eff"), r("bkg_rej").alias("bkg_rej"))


@query(
    "exact_auc",
    f"""WITH g AS (SELECT slice, score, sum(CASE WHEN label = 1 THEN weight ELSE 0 END) AS p,
            sum(CASE WHEN label = 0 THEN weight ELSE 0 END) AS n FROM jets WHERE label IS NOT NULL GROUP BY slice, score),
        c AS (SELECT *, sum(n) OVER (PARTITION BY slice ORDER BY score) AS below FROM g)
        SELECT slice, {R('sum(p * (below - n * 0.5e0)) / (sum(p) * sum(n))')} AS auc FROM c GROUP BY slice""",
)
def exact_auc(spark, d):
    out = metrics.auc(jets(spark, d), "score", "label", "weight", ["slice"])
    return out.select("slice", r("auc").alias("auc"))


@query(
    "roc_points",
    f"""WITH g AS (SELECT score, sum(CASE WHEN label = 1 THEN weight ELSE 0 END) AS p,
            sum(CASE WHEN label = 0 THEN weight ELSE 0 END) AS n FROM jets WHERE label IS NOT NULL GROUP BY score)
        SELECT {R('score', 9)} AS threshold, {R('sum(n) OVER (ORDER BY score DESC) / (SELECT sum(n) FROM g)')} AS fpr,
            {R('sum(p) OVER (ORDER BY score DESC) / (SELECT sum(p) FROM g)')} AS tpr FROM g""",
)
def roc_points(spark, d):
    out = metrics.roc_points(jets(spark, d), "score", "label", "weight")
    return out.select(r("threshold", 9).alias("threshold"), r("fpr").alias("fpr"), r("tpr").alias("tpr"))


@query(
    "confusion_matrix",
    """WITH c AS (SELECT label, sum(CASE WHEN score <= 0.5e0 THEN weight ELSE 0e0 END) AS a,
            sum(CASE WHEN score > 0.5e0 THEN weight ELSE 0e0 END) AS b FROM jets WHERE label IS NOT NULL GROUP BY label)
        SELECT label, round(a * 1000 / (a + b), 0) AS pred_0, round(b * 1000 / (a + b), 0) AS pred_1 FROM c""",
)
def confusion_matrix(spark, d):
    df = known(spark, d).withColumn("pred", labels.predicted_class(F.col("score")))
    return metrics.confusion_matrix(df, "label", "pred", [0, 1], "weight")


SCORE_EDGES = Binning("score", 50, 0.0, 1.0).edges


@query(
    "score_histogram_per_class",
    f"""SELECT label, {case_bins('score', SCORE_EDGES)} AS bin, {R('sum(weight)')} AS value FROM jets
        WHERE label IS NOT NULL GROUP BY 1, 2""",
)
def score_histogram_per_class(spark, d):
    out = metrics.score_histogram(known(spark, d), "score", "label", 50, "weight")
    return out.select("label", "bin", r("value").alias("value"))


@query(
    "tag_counts_per_truth",
    "SELECT parton, (score > 0.5e0)::INT AS tag, count(*) AS n FROM jets GROUP BY 1, 2",
)
def tag_counts_per_truth(spark, d):
    return metrics.tag_counts(jets(spark, d).withColumn("tag", labels.predicted_class(F.col("score"))), "parton", "tag")


# ---------------------------------------------------------------- everything


def all_metrics_sql(by: str, source: str, threshold: str = "0.5e0", score: str = "score") -> str:
    """SQL with CTEs: every metric per group. ``source`` has score, label, weight and the keys."""
    return f"""k AS (SELECT * FROM {source} WHERE label IS NOT NULL),
        {scan_sql(by, source='k', score=score)}, {best_sql('tpr', 0.5, by)},
        pts AS (SELECT {by}, idx, CASE WHEN idx = 0 THEN 1e0 WHEN idx = 199 THEN 0e0 ELSE tpr END AS y,
            CASE WHEN idx = 0 THEN 1e0 WHEN idx = 199 THEN 0e0 ELSE 1e0 - tnr END AS x FROM scan),
        area AS (SELECT {by}, sum((px - x) * (py + y) / 2) AS auc FROM (SELECT *, lag(x) OVER (PARTITION BY {by} ORDER BY idx)
            AS px, lag(y) OVER (PARTITION BY {by} ORDER BY idx) AS py FROM pts) GROUP BY {by}),
        s AS (SELECT {by}, sum(CASE WHEN ({score} > 0.5e0)::INT = label THEN weight ELSE 0 END) / sum(weight) AS acc,
            sum(CASE WHEN label = 0 AND {score} <= {threshold} THEN weight ELSE 0 END) / nullif(sum(CASE WHEN label = 0 THEN weight ELSE 0 END), 0) AS g,
            sum(CASE WHEN label = 1 AND {score} > {threshold} THEN weight ELSE 0 END) / nullif(sum(CASE WHEN label = 1 THEN weight ELSE 0 END), 0) AS q,
            count(*) AS num_events, sum(weight) * sum(weight) / sum(weight * weight) AS ne,
            sum(CASE WHEN label = 1 THEN weight END) * sum(CASE WHEN label = 1 THEN weight END) / sum(CASE WHEN label = 1 THEN weight * weight END) AS nq,
            sum(CASE WHEN label = 0 THEN weight END) * sum(CASE WHEN label = 0 THEN weight END) / sum(CASE WHEN label = 0 THEN weight * weight END) AS ng
            FROM k GROUP BY {by}),
        m AS (SELECT s.*, auc, 1e0 / nullif(1e0 - best.tnr, 0) AS rej50, best.t AS thr50
            FROM s LEFT JOIN area USING ({by}) LEFT JOIN best USING ({by}))"""


METRIC_COLUMNS = ", ".join(
    f"{R(expr)} AS {name}"
    for name, expr in {
        "binary_accuracy": "acc",
        "auc": "auc",
        "gluon_efficiency": "g",
        "quark_efficiency": "q",
        "gluon_rejection": "1e0 / nullif(1e0 - g, 0)",
        "quark_rejection": "1e0 / nullif(1e0 - q, 0)",
        "gluon_rejection_at_quark_50wp": "rej50",
        "threshold_at_fixed_quark_50wp": "thr50",
        "eff_num_events": "ne",
        "eff_num_events_q": "nq",
        "eff_num_events_g": "ng",
    }.items()
)
METRIC_NAMES = [*metrics.METRICS, "eff_num_events", "eff_num_events_q", "eff_num_events_g"]


def neat(df, *keys):
    return df.select(*keys, "num_events", *[r(c).alias(c) for c in METRIC_NAMES])


@query(
    "all_metrics_per_slice",
    f"WITH {all_metrics_sql('slice', 'jets')} SELECT slice, num_events, {METRIC_COLUMNS} FROM m",
    ("jets", "thr"),
)
def all_metrics_per_slice(spark, d):
    return neat(metrics.all_metrics(jets(spark, d), "score", "label", "weight", ["slice"]), "slice")


WIDE = Binning("jets_pt", [*PT.edges, 600000.005])  # the last bin is empty


@query(
    "binned_metrics",
    f"""WITH b AS (SELECT *, {case_bins('jets_pt', WIDE.edges, right_closed=True)} AS bin FROM jets),
        {all_metrics_sql('bin', '(SELECT * FROM b WHERE bin IS NOT NULL)')}
        SELECT f.i::INT AS bin, num_events, {METRIC_COLUMNS} FROM range({WIDE.n_bins}) f(i) LEFT JOIN m ON f.i = m.bin""",
    ("jets", "thr"),
)
def binned_metrics(spark, d):
    return neat(metrics.binned_metrics(jets(spark, d), WIDE, "score", "label", "weight"), "bin")


@query(
    "metrics_from_ingested_chunks",
    f"WITH {all_metrics_sql('slice', 'jets')} SELECT slice, num_events, {METRIC_COLUMNS} FROM m",
    ("jets", "thr"),
)
def metrics_from_ingested_chunks(spark, d):
    """States kept chunk by chunk, one of them twice as after a failure, give the metrics of all rows."""
    df, path = jets(spark, d), io.shared_folder(spark)
    generators = ["F", "O", "P"]
    for chunk in (0, 1, 1, 2):
        part = df.where(F.col("generator") == generators[chunk])
        metrics.save_state(metrics.metric_state(part, "score", "label", "weight", ["slice"]), path, chunk)
    merged = metrics.load_state(spark, path, ["slice"])
    return neat(metrics.metrics_of_state(merged, ["slice"]), "slice")


@query(
    "binned_metrics_by_generator",
    f"""WITH b AS (SELECT *, {case_bins('jets_pt', WIDE.edges, right_closed=True)} AS bin FROM jets),
        {all_metrics_sql('generator, bin', '(SELECT * FROM b WHERE bin IS NOT NULL)')}
        SELECT g.generator, f.i::INT AS bin, num_events, {METRIC_COLUMNS} FROM (SELECT DISTINCT generator FROM jets WHERE label IS NOT NULL) g,
            range({WIDE.n_bins}) f(i) LEFT JOIN m ON f.i = m.bin AND g.generator = m.generator""",
    ("jets", "thr"),
)
def binned_metrics_by_generator(spark, d):
    """Every bin of every generator, the empty last one too."""
    return neat(metrics.binned_metrics(jets(spark, d), WIDE, "score", "label", "weight", by=["generator"]), "generator", "bin")


CUTS = {"all": "jets_pt > 0", "central": "-2.1 < jets_eta < 2.1", "hard": "jets_pt > 200_000 and slice < 4"}
CUTS_SQL = {
    "all": "jets_pt > 0e0",
    "central": "jets_eta > -2.1e0 AND jets_eta < 2.1e0",
    "hard": "jets_pt > 200000e0 AND slice < 4",
}


@query(
    "metrics_by_cut_and_binning",
    "WITH c AS ("
    + " UNION ALL ".join(f"SELECT *, '{name}' AS cut FROM jets WHERE {text}" for name, text in CUTS_SQL.items())
    + "), v AS ("
    + " UNION ALL ".join(
        f"SELECT *, '{b.variable}' AS variable, {case_bins(b.variable, b.edges, right_closed=True)} AS bin FROM c"
        for b in (WIDE, ETA)
    )
    + f"), {all_metrics_sql('cut, variable, bin', '(SELECT * FROM v WHERE bin IS NOT NULL)')}"
    + f" SELECT f.cut, f.variable, f.bin::INT AS bin, num_events, {METRIC_COLUMNS} FROM ("
    + " UNION ALL ".join(f"SELECT '{name}' AS cut, '{b.variable}' AS variable, i AS bin FROM range({b.n_bins}) x(i)" for name in CUTS_SQL for b in (WIDE, ETA))
    + ") f LEFT JOIN m ON f.cut = m.cut AND f.variable = m.variable AND f.bin = m.bin",
    ("jets", "thr"),
)
def metrics_by_cut_and_binning(spark, d):
    df = jets(spark, d)
    cuts = {name: row_query(df, text) for name, text in CUTS.items()}
    out = metrics.metrics_by_cut(df, [WIDE, ETA], cuts, "score", "label", "weight")
    return neat(out, "cut", "variable", "bin")


@query(
    "working_point_per_bin",
    f"""WITH b AS (SELECT *, {PT_BIN_RIGHT} AS bin FROM jets WHERE label IS NOT NULL),
        {scan_sql('bin', source='(SELECT * FROM b WHERE bin IS NOT NULL)')}, {best_sql('tpr', 0.5, 'bin')},
        e AS (SELECT b.bin, sum(CASE WHEN label = 0 AND score <= t THEN weight ELSE 0 END) / sum(CASE WHEN label = 0 THEN weight END) AS g,
            sum(CASE WHEN label = 1 AND score > t THEN weight ELSE 0 END) / sum(CASE WHEN label = 1 THEN weight END) AS q
            FROM b JOIN best USING (bin) GROUP BY b.bin)
        SELECT bin, {R('g')} AS gluon_efficiency, {R('q')} AS quark_efficiency, {R('best.t')} AS threshold
        FROM e JOIN best USING (bin)""",
    ("jets", "thr"),
)
def working_point_per_bin(spark, d):
    """Derive a threshold per bin, store it, read it back for the same binning and use it."""
    df = jets(spark, d)
    path = io.shared_folder(spark)
    io.save_binned(metrics.bin_thresholds(df, PT, "score", "label", 0.5, "weight"), path)
    stored = io.load_binned(spark, path, PT)
    out = metrics.binned_metrics(df, PT, "score", "label", "weight", stored)
    return out.join(stored.select("bin", r("value").alias("threshold")), "bin").select(
        "bin", r("gluon_efficiency").alias("gluon_efficiency"), r("quark_efficiency").alias("quark_efficiency"), "threshold"
    )


ABS_ETA = Binning("abs_eta", [0.0, 0.505, 1.005, 2.105, 4.605])
TARGETS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


@query(
    "efficiency_grid",
    f"""WITH b AS (SELECT *, {PT_BIN_RIGHT} AS bin_1, {case_bins('abs(jets_eta)', ABS_ETA.edges, right_closed=True)} AS bin_2
            FROM jets WHERE label IS NOT NULL),
        k AS (SELECT * FROM b WHERE bin_1 IS NOT NULL AND bin_2 IS NOT NULL), {scan_sql('bin_1, bin_2', source='k')},
        w AS (SELECT unnest([{', '.join(f'{t!r}::DOUBLE' for t in TARGETS)}]) AS wp),
        p AS (SELECT *, row_number() OVER (PARTITION BY bin_1, bin_2, wp ORDER BY (tpr - wp) * (tpr - wp), idx) AS nth FROM scan, w
            WHERE tpr IS NOT NULL),
        n AS (SELECT bin_1, bin_2, sum(weight) * sum(weight) / sum(weight * weight) AS ng FROM k WHERE label = 0 GROUP BY 1, 2),
        c AS (SELECT * FROM (SELECT DISTINCT bin_1, bin_2 FROM k), w)
        SELECT bin_1, bin_2, wp AS quark_efficiency, {R('1e0 - tnr')} AS gluon_efficiency,
            {R('sqrt((1e0 - tnr) * tnr / ng)')} AS stat_err
        FROM c LEFT JOIN (SELECT * FROM p WHERE nth = 1) USING (bin_1, bin_2, wp) LEFT JOIN n USING (bin_1, bin_2)""",
    ("jets", "thr"),
)
def efficiency_grid(spark, d):
    df = jets(spark, d).withColumn("abs_eta", F.abs("jets_eta"))
    out = metrics.efficiency_grid(df, PT, ABS_ETA, "score", "label", "weight", TARGETS)
    return out.select(
        "bin_1", "bin_2", "quark_efficiency", r("gluon_efficiency").alias("gluon_efficiency"), r("stat_err").alias("stat_err")
    )


@query(
    "metric_errors",
    f"""WITH b AS (SELECT *, {PT_BIN_RIGHT} AS bin FROM jets), {all_metrics_sql('bin', '(SELECT * FROM b WHERE bin IS NOT NULL)')},
        e AS (SELECT *, 1e0 / (1e0 - g) AS gr FROM m)
        SELECT bin, {R('sqrt(q * (1 - q) / nq)')} AS quark_efficiency_err, {R('sqrt(acc * (1 - acc) / ne)')} AS binary_accuracy_err,
            {R('sqrt(1e0 / gr * (1e0 - 1e0 / gr) / ng) * gr * gr')} AS gluon_rejection_err FROM e""",
    ("jets", "thr"),
)
def metric_errors(spark, d):
    out = metrics.binned_metrics(jets(spark, d), PT, "score", "label", "weight", keep_empty=False)
    out = metrics.metric_errors(out, ["quark_efficiency", "binary_accuracy", "gluon_rejection", "auc"])
    names = ["quark_efficiency_err", "binary_accuracy_err", "gluon_rejection_err"]
    return out.select("bin", *[r(c).alias(c) for c in names])


@query(
    "rejection_at_bin_efficiency",
    f"""WITH g AS (SELECT {PT_BIN_RIGHT} AS bin, score, sum(CASE WHEN label = 1 THEN weight ELSE 0 END) AS p,
            sum(CASE WHEN label = 0 THEN weight ELSE 0 END) AS n FROM jets WHERE label IS NOT NULL GROUP BY 1, 2),
        c AS (SELECT *, sum(p) OVER (PARTITION BY bin ORDER BY score) AS cp, sum(n) OVER (PARTITION BY bin ORDER BY score) AS cn,
            sum(p) OVER (PARTITION BY bin) AS tp, sum(n) OVER (PARTITION BY bin) AS tn FROM g),
        w AS (SELECT unnest([0.5e0, 0.8e0]) AS target),
        f AS (SELECT *, row_number() OVER (PARTITION BY bin, target ORDER BY score) AS nth FROM c, w
            WHERE cp >= (1 - target) * tp - 1e-9 * tp)
        SELECT bin, target, {R('score')} AS threshold, {R('tn / nullif(tn - cn, 0)')} AS bkg_rejection FROM f WHERE nth = 1""",
)
def rejection_at_bin_efficiency(spark, d):
    out = metrics.rejection_at_bin_efficiency(jets(spark, d), PT, "score", "label", (0.5, 0.8), "weight")
    return out.select("bin", "target", r("threshold").alias("threshold"), r("bkg_rejection").alias("bkg_rejection"))


def class_scores(spark, d):
    """Three-class scores that sum to one, and the class index of the slice."""
    df = jets(spark, d).withColumn("class", F.col("slice") % 3)
    raw = [
        1.0 + ((F.col("jet_id") * k) % 997).cast("double") / 997.0 + F.when(F.col("class") == i, 0.5).otherwise(0.0)
        for i, k in enumerate((7919, 6271, 3571))
    ]
    df = df.withColumns({f"s{i}": x for i, x in enumerate(raw)}).withColumn("total", F.col("s0") + F.col("s1") + F.col("s2"))
    return df.select("jet_id", "class", "weight", F.array(*[F.col(f"s{i}") / F.col("total") for i in range(3)]).alias("scores"))


CLASS_SCORES = """x AS (SELECT jet_id, (slice % 3)::INT AS class, weight,
        1e0 + ((jet_id * 7919) % 997)::DOUBLE / 997e0 + CASE WHEN slice % 3 = 0 THEN 0.5e0 ELSE 0e0 END AS r0,
        1e0 + ((jet_id * 6271) % 997)::DOUBLE / 997e0 + CASE WHEN slice % 3 = 1 THEN 0.5e0 ELSE 0e0 END AS r1,
        1e0 + ((jet_id * 3571) % 997)::DOUBLE / 997e0 + CASE WHEN slice % 3 = 2 THEN 0.5e0 ELSE 0e0 END AS r2 FROM jets),
    y AS (SELECT *, r0 / (r0 + r1 + r2) AS s0, r1 / (r0 + r1 + r2) AS s1, r2 / (r0 + r1 + r2) AS s2 FROM x)"""


@query(
    "one_class_against_background",
    f"""WITH {CLASS_SCORES}, z AS (SELECT 1 AS sig, s1 / (s1 + s0) AS score, (class <> 0)::INT AS label, weight FROM y WHERE class IN (0, 1)
            UNION ALL SELECT 2, s2 / (s2 + s0), (class <> 0)::INT, weight FROM y WHERE class IN (0, 2)),
        {scan_sql('sig', source='z')}, w AS (SELECT * FROM (VALUES (1, 0.5e0), (2, 0.7e0)) v(sig, wp)),
        p AS (SELECT *, row_number() OVER (PARTITION BY sig ORDER BY (tpr - wp) * (tpr - wp), idx) AS nth FROM scan JOIN w USING (sig))
        SELECT sig::INT AS class, wp AS working_point, {R('1e0 / nullif(1e0 - tnr, 0)')} AS rejection, {R('t')} AS threshold
        FROM p WHERE nth = 1""",
    ("jets", "thr"),
)
def one_class_against_background(spark, d):
    out = metrics.one_against_background(class_scores(spark, d), "scores", "class", 0, {1: 0.5, 2: 0.7}, "weight")
    return out.select("class", "working_point", r("rejection").alias("rejection"), r("threshold").alias("threshold"))


@query(
    "multiclass_accuracy_and_auc",
    f"""WITH {CLASS_SCORES}, z AS (SELECT 0 AS c, s0 AS score, (class = 0)::INT AS label, 1e0 AS weight FROM y
            UNION ALL SELECT 1, s1, (class = 1)::INT, 1e0 FROM y UNION ALL SELECT 2, s2, (class = 2)::INT, 1e0 FROM y),
        {all_metrics_sql('c', 'z')},
        a AS (SELECT avg((CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END = class)::INT) AS accuracy FROM y)
        SELECT {R('any_value(accuracy)')} AS accuracy, {R('avg(auc)')} AS auc FROM m, a""",
    ("jets", "thr"),
)
def multiclass_accuracy_and_auc(spark, d):
    out = metrics.multiclass_summary(class_scores(spark, d), "scores", "class", 3)
    return out.select(r("accuracy").alias("accuracy"), r("auc").alias("auc"))


@query(
    "evaluate_models",
    "WITH a AS (SELECT *, 0.7e0 * ((jet_id * 6271) % 10007)::DOUBLE / 10007e0 + CASE WHEN label = 1 THEN 0.3e0 ELSE 0e0 END AS score_b FROM jets),"
    " k2 AS (SELECT label, weight, 'A' AS model, score FROM a UNION ALL SELECT label, weight, 'B', score_b FROM a), "
    + all_metrics_sql("model", "k2")
    + f" SELECT model, num_events, {METRIC_COLUMNS} FROM m",
    ("jets", "thr"),
)
def evaluate_models(spark, d):
    df = jets(spark, d).withColumn("score_b", tables.model_score(6271, 0.3))
    overall, _ = evaluation.evaluate(df, {"A": "score", "B": "score_b"}, "label", "weight")
    return neat(overall, "model")


@query(
    "evaluate_models_by_cut",
    "WITH a AS (SELECT *, 0.7e0 * ((jet_id * 6271) % 10007)::DOUBLE / 10007e0 + CASE WHEN label = 1 THEN 0.3e0 ELSE 0e0 END AS score_b FROM jets),"
    " k2 AS (SELECT * EXCLUDE (score, score_b), 'A' AS model, score FROM a UNION ALL SELECT * EXCLUDE (score, score_b), 'B', score_b FROM a), c AS ("
    + " UNION ALL ".join(f"SELECT *, '{name}' AS cut FROM k2 WHERE {text}" for name, text in CUTS_SQL.items())
    + f"), v AS (SELECT *, 'jets_pt' AS variable, {case_bins('jets_pt', WIDE.edges, right_closed=True)} AS bin FROM c)"
    + f", {all_metrics_sql('model, cut, variable, bin', '(SELECT * FROM v WHERE bin IS NOT NULL)')}"
    + f" SELECT x.model, f.cut, f.bin::INT AS bin, num_events, {METRIC_COLUMNS} FROM (VALUES ('A'), ('B')) x(model), ("
    + " UNION ALL ".join(f"SELECT '{name}' AS cut, i AS bin FROM range({WIDE.n_bins}) y(i)" for name in CUTS_SQL)
    + ") f LEFT JOIN m ON x.model = m.model AND f.cut = m.cut AND f.bin = m.bin",
    ("jets", "thr"),
)
def evaluate_models_by_cut(spark, d):
    """Every model, cut and bin from one scan of the rows."""
    df = jets(spark, d).withColumn("score_b", tables.model_score(6271, 0.3))
    cuts = {name: row_query(df, text) for name, text in CUTS.items()}
    _, binned = evaluation.evaluate(df, {"A": "score", "B": "score_b"}, "label", "weight", [WIDE], cuts)
    return neat(binned, "model", "cut", "bin")
