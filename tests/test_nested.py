import pytest
from pyspark.sql import functions as F

from sparkjets.operators import nested

SCHEMA = (
    "jets_PartonTruthLabelID array<int>, jets_pt array<int>, jets_n int, HLT int, vertex_id array<int>, "
    "ragged_vertex_id array<array<int>>, jets_const_pt array<array<int>>"
)


def event(spark, labels, pt, const):
    return spark.createDataFrame([(labels, pt, 5, 1, [1, 2, 3], [[1], [2, 3]], const)], SCHEMA)


def test_filter_elements(spark):
    df = event(spark, [1, -1, 2, 3, -999], [1, 2, 3, 4, 5], [[1], [2], [3, 3], [4], [5]])
    row = nested.filter_elements(df, "jets_PartonTruthLabelID", [1, 2, 3]).first()
    assert row.jets_PartonTruthLabelID == [1, 2, 3]
    assert row.jets_pt == [1, 3, 4]
    assert row.jets_const_pt == [[1], [3, 3], [4]]
    assert (row.jets_n, row.HLT, row.vertex_id, row.ragged_vertex_id) == (5, 1, [1, 2, 3], [[1], [2, 3]])


def test_explode_aligned(spark):
    df = event(spark, [1, 2, 3], [10, 20, 30], [[1], [2, 2], []])
    rows = nested.explode_aligned(df).orderBy("jets_index").collect()
    assert [r.jets_index for r in rows] == [0, 1, 2]
    assert [r.jets_pt for r in rows] == [10, 20, 30]
    assert [r.jets_const_pt for r in rows] == [[1], [2, 2], []]
    assert all(r.vertex_id == [1, 2, 3] and r.jets_n == 5 and r.HLT == 1 for r in rows)


@pytest.mark.parametrize("labels, kept", [([1, 2], 1), ([], 0)])
def test_drop_empty(spark, labels, kept):
    df = event(spark, labels, [1] * len(labels), [[1]] * len(labels))
    assert nested.drop_empty(df, "jets_PartonTruthLabelID").count() == kept
    assert nested.explode_aligned(df).count() == len(labels)


def test_flatten_order_of_steps(spark):
    """The first jets are taken before the cuts, and cuts apply without wanted values too."""
    df = event(spark, [1, 21, 2], [5, 50, 500], [[1], [2], [3]])
    flat = nested.flatten_events(df, cuts={"jets_pt": (10, None)}, max_items=2)
    assert [(r.jets_index, r.jets_pt) for r in flat.collect()] == [(0, 50)]
    wanted = nested.flatten_events(df, "jets_PartonTruthLabelID", [1, 2], drop=["HLT", "nothing"])
    assert sorted(r.jets_pt for r in wanted.collect()) == [5, 500]
    assert "HLT" not in wanted.columns


def test_pad_node_and_edge(spark):
    df = spark.createDataFrame(
        [([0.0, 1.0, 2.0], [[0.0, 1.0, 2.0], [3.0, 4.0, 5.0], [6.0, 7.0, 8.0]])], "node array<double>, edge array<array<double>>"
    )
    row = nested.pad_records(df, 5, -999.0, "node", "edge").first()
    assert row.node == [0.0, 1.0, 2.0, -999.0, -999.0]
    assert row.mask == [True, True, True, False, False]
    assert len(row.edge) == 5 and all(len(r) == 5 for r in row.edge)
    assert row.edge[1] == [3.0, 4.0, 5.0, -999.0, -999.0] and row.edge[4] == [-999.0] * 5
    cut = nested.pad_records(df, 2, 0.0, "node", "edge").first()
    assert cut.node == [0.0, 1.0] and cut.edge == [[0.0, 1.0], [3.0, 4.0]] and cut.mask == [True, True]


def test_explode_to_scalars(spark):
    df = spark.createDataFrame([(1, [[1.0, 2.0], [3.0]], [[4.0, 5.0], [6.0]], 7.0)], "id int, a array<array<double>>, b array<array<double>>, s double")
    rows = nested.explode_to_scalars(df, ["a", "b", "s"]).collect()
    assert sorted((r.a, r.b, r.s) for r in rows) == [(1.0, 4.0, 7.0), (2.0, 5.0, 7.0), (3.0, 6.0, 7.0)]


def test_central_jet(spark):
    df = spark.createDataFrame([(1, [2.0, -1.0, 0.1]), (2, [1.0, -1.0]), (3, [3.0])], "id int, jets_eta array<double>")
    flags = {r.id: r.jets_is_central for r in nested.central_jet_flags(df).collect()}
    assert flags == {1: [0, 1, 0], 2: [1, 0], 3: [1]}


def test_nest_keeps_the_leading_items_of_a_hot_key(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"), F.col("id").alias("v")
    )
    out = nested.nest(df, ["k"], [F.col("v").desc()], {"vs": "v"}, max_items=5)
    hot = out.where("k = 0").first()
    assert hot.vs == [2997, 2994, 2991, 2988, 2985]
    assert out.count() == df.select("k").distinct().count()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # the partial limit runs before the shuffle
