"""Projections, labels, the two text languages and row filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkjets.catalog.base import R, query, r
from sparkjets.functions import labels, lang
from sparkjets.functions.arrays import one_hot
from sparkjets.operators import select
from sparkjets.sources import tables

jets = tables.jets


@query(
    "map_record",
    f"SELECT jet_id, {R('jets_pt * 0.001e0')} AS pt_gev, {R('jets_m / jets_pt')} AS m_over_pt FROM jets",
)
def map_record(spark, d):
    return select.map_columns(
        jets(spark, d),
        lambda df: {"jet_id": F.col("jet_id"), "pt_gev": r(df.jets_pt * 0.001), "m_over_pt": r(df.jets_m / df.jets_pt)},
    )


@query(
    "apply_dataset_function",
    f"SELECT label, count(*) AS n, {R('sum(weight)')} AS w FROM jets WHERE label IS NOT NULL GROUP BY label",
)
def apply_dataset_function(spark, d):
    from sparkjets import JetDataset

    def summarise(df):
        return df.where("label is not null").groupBy("label").agg(F.count("*").alias("n"), r(F.sum("weight")).alias("w"))

    return JetDataset.from_dataframe(jets(spark, d)).apply(summarise).df


@query(
    "pick_features_target_weight",
    f"""SELECT jet_id AS id, {R('jets_pt')} AS jets_pt, {R('jets_pt/1000e0 + jets_m*2e0')} AS mixed,
        weight_0 AS nominal, label, weight FROM (SELECT *, weight AS weight_0 FROM jets)""",
)
def pick_features_target_weight(spark, d):
    picked = select.pick(
        jets(spark, d), ["jet_id", "jets_pt", "jets_pt/1000+jets_m*2", "weight_mc[0]", "label"], "label", "weight"
    )
    f = F.col("features")
    return picked.select(
        f["jet_id"].alias("id"),
        r(f["jets_pt"]).alias("jets_pt"),
        r(f["jets_pt/1000+jets_m*2"]).alias("mixed"),
        f["weight_mc[0]"].alias("nominal"),
        "label",
        "weight",
    )


@query(
    "multilabel_from_flags",
    """SELECT jet_id, (CASE WHEN jet_id % 5 = 0 THEN 2 WHEN jet_id % 3 = 0 THEN 1 WHEN jet_id % 2 = 0 THEN 0
        ELSE -1 END)::INT AS class FROM jets""",
)
def multilabel_from_flags(spark, d):
    flagged = jets(spark, d).select(
        "jet_id", *[(F.col("jet_id") % k == 0).cast("int").alias(f"is_{k}") for k in (2, 3, 5)]
    )
    return select.multilabel(flagged, ["is_2", "is_3", "is_5"], "class").select("jet_id", "class")


@query("remap_labels", "SELECT jet_id, (1 - label)::INT AS label FROM jets")
def remap_labels(spark, d):
    return select.remap_labels(jets(spark, d), lambda x: (1 - x).cast("int")).select("jet_id", "label")


@query(
    "group_labels_to_classes",
    """SELECT jet_id, (CASE WHEN parton = 5 THEN 2 WHEN parton BETWEEN 1 AND 5 THEN 0 WHEN parton = 21 THEN 1
        ELSE -999 END)::INT AS class FROM jets""",
)
def group_labels_to_classes(spark, d):
    classes = labels.class_index(F.col("parton"), [(1, 2, 3, 4, 5), 21, (5,)])
    return jets(spark, d).select("jet_id", classes.alias("class"))


@query(
    "one_hot_labels",
    """SELECT jet_id, (CASE WHEN slice = 1 THEN 1e0 ELSE 0e0 END) AS c0, (CASE WHEN slice = 2 THEN 1e0 ELSE 0e0 END) AS c1,
        (CASE WHEN slice = 3 THEN 1e0 ELSE 0e0 END) AS c2 FROM jets""",
)
def one_hot_labels(spark, d):
    return (
        jets(spark, d)
        .select("jet_id", one_hot(F.col("slice") - 1, 3).alias("v"))
        .select("jet_id", *[F.col("v")[i].alias(f"c{i}") for i in range(3)])
    )


@query(
    "parton_class_and_name",
    """SELECT jet_id, coalesce(label, -1)::INT AS tag, CASE parton WHEN 1 THEN 'd' WHEN 2 THEN 'u' WHEN 3 THEN 's'
        WHEN 4 THEN 'c' WHEN 5 THEN 'b' WHEN 6 THEN 't' WHEN 21 THEN 'g' ELSE 'other' END AS letter FROM jets""",
)
def parton_class_and_name(spark, d):
    return jets(spark, d).select(
        "jet_id",
        labels.quark_gluon(F.col("parton")).cast("int").alias("tag"),
        labels.lookup(F.col("parton"), labels.PARTON_LETTERS, "other").alias("letter"),
    )


@query(
    "replace_values_by_name",
    "SELECT jet_id, CASE generator WHEN 'F' THEN 'Fast' WHEN 'O' THEN 'Open' ELSE generator END AS generator FROM jets",
)
def replace_values_by_name(spark, d):
    return jets(spark, d).select("jet_id", "generator").replace({"F": "Fast", "O": "Open"}, subset=["generator"])


@query("drop_listed_columns", "SELECT jet_id, jets_pt, label, weight FROM jets")
def drop_listed_columns(spark, d):
    small = jets(spark, d).select("jet_id", "jets_pt", "jets_eta", "label", "weight")
    return select.drop_columns(small, ["jets_eta", "no_such_column"])


@query("drop_columns_by_pattern", "SELECT jet_id, event_id, parton, label, slice, generator FROM jets")
def drop_columns_by_pattern(spark, d):
    return select.drop_matching(jets(spark, d), "jets_|weight|score")


@query("add_constant_column", "SELECT jet_id, 7::INT AS sample_id, 'nominal' AS campaign FROM jets")
def add_constant_column(spark, d):
    tagged = select.add_constant(select.add_constant(jets(spark, d), "sample_id", 7), "campaign", "nominal")
    return tagged.select("jet_id", "sample_id", "campaign")


@query(
    "leading_element_of_prefixed",
    f"""SELECT jets_id0 AS id, {R('jets_pt0')} AS pt, {R('jets_eta0')} AS eta FROM (SELECT event_id,
        min(CASE WHEN pos = 0 THEN jet_id END) AS jets_id0, min(CASE WHEN pos = 0 THEN jets_pt END) AS jets_pt0,
        min(CASE WHEN pos = 0 THEN jets_eta END) AS jets_eta0 FROM ejets GROUP BY event_id)""",
    ("ejets",),
)
def leading_element_of_prefixed(spark, d):
    return select.leading(tables.events_nested(spark, d), "jets_").select("id", r("pt").alias("pt"), r("eta").alias("eta"))


@query("rename_columns", "SELECT jet_id AS id, jets_pt AS pt, jets_eta AS eta FROM jets")
def rename_columns(spark, d):
    return (
        jets(spark, d)
        .select("jet_id", "jets_pt", "jets_eta")
        .withColumnsRenamed({"jet_id": "id", "jets_pt": "pt", "jets_eta": "eta"})
    )


@query(
    "text_expressions",
    f"""SELECT jet_id, {R('jets_pt / 1000e0 - jets_m - 1e0')} AS standard, {R('jets_pt / 1000e0 - (jets_m - 1e0)')} AS legacy,
        {R('weight * 1.1e0')} AS second, {R('weight * 0.9e0 / weight')} AS ratio FROM jets""",
)
def text_expressions(spark, d):
    df = jets(spark, d)
    return df.select(
        "jet_id",
        r(lang.expression(df, "jets_pt/1000 - jets_m - 1")).alias("standard"),
        r(lang.expression(df, "jets_pt/1000-jets_m-1", legacy=True)).alias("legacy"),
        r(lang.expression(df, "weight_mc[1]")).alias("second"),
        r(lang.expression(df, "weight_mc[-1] / weight_mc[0]")).alias("ratio"),
    )


@query("derived_sum_column", f"SELECT jet_id, (slice + parton)::INT AS total, {R('jets_pt + jets_m')} AS pt_m FROM jets")
def derived_sum_column(spark, d):
    df = jets(spark, d)
    return df.select(
        "jet_id",
        lang.expression(df, "slice + parton").cast("int").alias("total"),
        r(lang.expression(df, "jets_pt + jets_m")).alias("pt_m"),
    )


@query("constituent_count", "SELECT jet_id, count(*)::INT AS n FROM lead GROUP BY jet_id", ("lead",))
def constituent_count(spark, d):
    return tables.nested_constituents(spark, d).select("jet_id", F.size("jets_Constituent_pt").alias("n"))


@query("rescale_and_abs", f"SELECT jet_id, {R('jets_pt * 1e-6', 9)} AS pt_tev, {R('abs(jets_eta)')} AS abs_eta FROM jets")
def rescale_and_abs(spark, d):
    return jets(spark, d).select(
        "jet_id", r(F.col("jets_pt") * 1e-6, 9).alias("pt_tev"), r(F.abs("jets_eta")).alias("abs_eta")
    )


@query("add_score_columns", f"SELECT jet_id, {R('jets_pt')} AS jets_pt, {R('score')} AS model_score FROM jets")
def add_score_columns(spark, d):
    from sparkjets.operators.combine import add_scores

    df = jets(spark, d)
    scores = df.select("jet_id", "score")
    joined = add_scores(df.drop("score"), scores, "jet_id", "model_score")
    return joined.select("jet_id", r("jets_pt").alias("jets_pt"), r("model_score").alias("model_score"))


@query(
    "predicted_class_names",
    """SELECT jet_id, (score > 0.5e0)::INT AS prediction, CASE WHEN score > 0.5e0 THEN 'quark' ELSE 'gluon' END AS tag
        FROM jets""",
)
def predicted_class_names(spark, d):
    df = jets(spark, d).withColumn("prediction", labels.predicted_class(F.col("score")))
    return df.select("jet_id", "prediction", labels.lookup(F.col("prediction"), {1: "quark", 0: "gluon"}).alias("tag"))


@query(
    "list_variables",
    """SELECT 'generator' AS variable, count(generator) AS filled FROM jets
        UNION ALL SELECT 'jets_pt', count(jets_pt) FROM jets UNION ALL SELECT 'label', count(label) FROM jets
        UNION ALL SELECT 'slice', count(slice) FROM jets""",
)
def list_variables(spark, d):
    df = jets(spark, d).select(F.struct("jets_pt", "slice").alias("features"), "label", "generator")
    flat = select.to_table(df.withColumnRenamed("label", "label_"))
    names = select.variables(df)
    counts = flat.withColumnRenamed("label_", "label").agg(*[F.count(n).alias(n) for n in names])
    return counts.unpivot([], names, "variable", "filled")


# ---------------------------------------------------------------------- filters


@query("filter_by_predicate", "SELECT jet_id, slice FROM jets WHERE slice > 2 AND label = 1")
def filter_by_predicate(spark, d):
    return select.where(jets(spark, d), lambda df: (df.slice > 2) & (df.label == 1)).select("jet_id", "slice")


@query("simple_cut", "SELECT jet_id, jets_pt FROM jets WHERE jets_pt >= 250000e0")
def simple_cut(spark, d):
    return select.where(jets(spark, d), lang.Cut("jets_pt>=250_000")).select("jet_id", "jets_pt")


@query(
    "simple_cut_on_array",
    "SELECT event_id FROM ejets GROUP BY event_id HAVING min(jets_pt) > 20000e0",
    ("ejets",),
)
def simple_cut_on_array(spark, d):
    return select.where(tables.events_nested(spark, d), lang.Cut("jets_pt>20_000")).select("event_id")


@query(
    "combined_cut",
    """SELECT jet_id, jets_pt, slice FROM jets WHERE (jets_pt > 100000e0 AND jets_eta < 2.1e0 AND jets_eta > -2.1e0)
        OR slice = 1 AND weight <> 3e0""",
)
def combined_cut(spark, d):
    acceptance = lang.Cut("(jets_pt>100_000) && (jets_eta<2.1) && (jets_eta>-2.1)")
    other = lang.Cut("(slice==1) && (weight!=3)")
    return select.where(jets(spark, d), acceptance | other).select("jet_id", "jets_pt", "slice")


@query("open_interval_cut", "SELECT jet_id FROM jets WHERE jets_eta > -2.1e0 AND jets_eta < 2.1e0")
def open_interval_cut(spark, d):
    return select.cut(jets(spark, d), "jets_eta", -2.1, 2.1).select("jet_id")


@query("keep_listed_values", "SELECT jet_id, parton FROM jets WHERE parton IN (1, 3, 21)")
def keep_listed_values(spark, d):
    return select.keep_values(jets(spark, d), "parton", [1, 3, 21]).select("jet_id", "parton")


@query("drop_unknown_labels", "SELECT jet_id, parton FROM jets WHERE parton NOT IN (-1, 6)")
def drop_unknown_labels(spark, d):
    return select.drop_values(jets(spark, d), "parton", [-1, 6]).select("jet_id", "parton")


@query(
    "row_query_text",
    "SELECT jet_id FROM jets WHERE jets_pt > 20000e0 AND jets_pt * 0.001e0 + slice > 60e0 AND NOT parton = 21",
)
def row_query_text(spark, d):
    return select.where(jets(spark, d), "jets_pt>20_000 and jets_pt*0.001 + slice > 60 & not parton == 21").select("jet_id")


@query(
    "slice_upper_cut",
    """SELECT jet_id, jz FROM (SELECT jet_id, jets_pt, slice AS jz,
        1.4e0 * [60e3, 160e3, 400e3, 800e3, 1300e3][slice] AS edge FROM jets) WHERE jets_pt < edge""",
)
def slice_upper_cut(spark, d):
    named = jets(spark, d).withColumn("name", F.concat(F.lit("mc_JZ"), F.col("slice"), F.lit("_evnt")))
    numbered = named.withColumn("jz", select.slice_number(F.col("name")))
    return select.slice_cut(numbered, F.col("jz")).select("jet_id", "jz")


@query("weight_window_cut", "SELECT jet_id, weight FROM jets WHERE weight > 1e0 AND weight < 5e0")
def weight_window_cut(spark, d):
    return select.cut(jets(spark, d), "weight", 1, 5).select("jet_id", "weight")


@query("bin_range_filter", "SELECT jet_id FROM jets WHERE jets_pt > 50000.005e0 AND jets_pt < 400000.005e0")
def bin_range_filter(spark, d):
    from sparkjets.functions.binning import Binning

    edges = Binning("jets_pt", [50000.005, 100000.005, 400000.005]).edges
    return select.cut(jets(spark, d), "jets_pt", edges[0], edges[-1]).select("jet_id")
