"""Nested records: flatten, filter and sort array elements, pad, vectors, neighbours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkjets.catalog.base import R, query, r
from sparkjets.functions import vectors
from sparkjets.functions.constituents import merged
from sparkjets.dataset import JetDataset
from sparkjets.operators import neighbours, nested, records
from sparkjets.sources import tables

events = tables.events_nested


def jets_of(df, *names):
    """The array columns of a nested frame as rows, for comparison."""
    return nested.explode_aligned(df).select("event_id", "jets_index", *names)


@query(
    "filter_elements_by_value",
    """SELECT event_id, (row_number() OVER (PARTITION BY event_id ORDER BY pos) - 1)::INT AS jets_index, jet_id AS jets_id,
        parton AS jets_parton, vertex_n FROM (SELECT *, 2::INT AS vertex_n FROM ejets) WHERE parton IN (1, 2, 3, 4, 5, 6, 21)""",
    ("ejets",),
)
def filter_elements_by_value(spark, d):
    kept = nested.filter_elements(events(spark, d), "jets_parton", [1, 2, 3, 4, 5, 6, 21])
    return jets_of(kept.withColumn("vertex_n", F.size("vertex_id")), "jets_id", "jets_parton", "vertex_n")


@query(
    "cut_elements_by_interval",
    """SELECT event_id, (row_number() OVER (PARTITION BY event_id ORDER BY pos) - 1)::INT AS jets_index, jet_id AS jets_id
        FROM ejets WHERE jets_pt > 50000e0 AND jets_pt < 400000e0""",
    ("ejets",),
)
def cut_elements_by_interval(spark, d):
    return jets_of(nested.cut_elements(events(spark, d), "jets_pt", 50_000.0, 400_000.0), "jets_id")


@query(
    "drop_empty_events",
    "SELECT event_id, count(*)::INT AS n FROM ejets WHERE jets_pt > 400000e0 GROUP BY event_id",
    ("ejets",),
)
def drop_empty_events(spark, d):
    hard = nested.cut_elements(events(spark, d), "jets_pt", 400_000.0)
    return nested.drop_empty(hard, "jets_pt").select("event_id", F.size("jets_pt").alias("n"))


@query(
    "first_jets_of_event",
    "SELECT event_id, pos::INT AS jets_index, jet_id AS jets_id FROM ejets WHERE pos < 2",
    ("ejets",),
)
def first_jets_of_event(spark, d):
    return jets_of(nested.first_elements(events(spark, d), 2), "jets_id")


@query(
    "flatten_events_to_jets",
    f"""SELECT e.event_id, pos::INT AS jets_index, jet_id AS jets_id, {R('jets_pt')} AS jets_pt, {R('c_acctbal')} AS mu
        FROM ejets e JOIN customer c ON e.event_id = c.c_custkey""",
    ("ejets",),
)
def flatten_events_to_jets(spark, d):
    flat = nested.explode_aligned(events(spark, d))
    return flat.select("event_id", "jets_index", "jets_id", r("jets_pt").alias("jets_pt"), r("mu").alias("mu"))


@query(
    "flatten_with_cuts",
    f"""SELECT e.event_id, (row_number() OVER (PARTITION BY e.event_id ORDER BY pos) - 1)::INT AS jets_index,
        jet_id AS jets_id, {R('jets_pt')} AS jets_pt, parton AS jets_parton, {R('c_acctbal')} AS mu
        FROM ejets e JOIN customer c ON e.event_id = c.c_custkey
        WHERE pos < 10 AND jets_pt > 100000e0 AND jets_eta > -2.1e0 AND jets_eta < 2.1e0 AND parton <> -1""",
    ("ejets",),
)
def flatten_with_cuts(spark, d):
    flat = nested.flatten_events(
        events(spark, d),
        reference="jets_parton",
        wanted=[1, 2, 3, 4, 5, 6, 21],
        cuts={"jets_pt": (100_000.0, None), "jets_eta": (-2.1, 2.1)},
        max_items=10,
        drop=["vertex_id", "HLT_pass"],
    )
    return flat.select(
        "event_id", "jets_index", "jets_id", r("jets_pt").alias("jets_pt"), "jets_parton", r("mu").alias("mu")
    )


@query(
    "explode_until_scalar",
    f"SELECT jet_id, {R('pt')} AS pt, {R('eta')} AS eta FROM lead",
    ("lead",),
)
def explode_until_scalar(spark, d):
    df = tables.nested_constituents(spark, d)
    boxed = df.select(
        "jet_id", F.array("jets_Constituent_pt").alias("pt"), F.array("jets_Constituent_eta").alias("eta")
    )
    flat = nested.explode_to_scalars(boxed, ["pt", "eta"])
    return flat.select("jet_id", r("pt").alias("pt"), r("eta").alias("eta"))


def events_of_jets_of_constituents(spark, d):
    """Events with an array of arrays: the constituents of each of their jets."""
    rows = tables.jets_nested(spark, d)
    columns = {"jets_id": "jet_id", "jets_pt": "jets_pt", "jets_constituents_pt": "jets_Constituent_pt", "jets_constituents_eta": "jets_Constituent_eta"}
    return nested.nest(rows, ["event_id"], [F.col("jets_pt").desc(), F.col("jet_id")], columns)


@query(
    "flatten_deep_events",
    f"""SELECT event_id, pos::INT AS jets_index, jet_id AS jets_id, coalesce(n, 0)::INT AS n, {R('coalesce(s, 0e0)', 2)} AS pt
        FROM ejets LEFT JOIN (SELECT jet_id, count(*) AS n, sum(pt) AS s FROM lead GROUP BY jet_id) USING (jet_id)""",
    ("ejets", "lead"),
)
def flatten_deep_events(spark, d):
    """Events to jets, which keep the arrays of their constituents, also empty ones."""
    flat = nested.explode_aligned(events_of_jets_of_constituents(spark, d))
    total = F.aggregate("jets_constituents_pt", F.lit(0.0), lambda a, x: a + x)
    return flat.select("event_id", "jets_index", "jets_id", F.size("jets_constituents_pt").alias("n"), r(total, 2).alias("pt"))


@query(
    "explode_deep_events",
    f"SELECT event_id, {R('pt')} AS pt, {R('eta')} AS eta FROM lead JOIN (SELECT jet_id, event_id FROM jets) USING (jet_id)",
    ("lead", "jets"),
)
def explode_deep_events(spark, d):
    """Two levels of arrays down to single constituents."""
    deep = events_of_jets_of_constituents(spark, d).select("event_id", "jets_constituents_pt", "jets_constituents_eta")
    flat = nested.explode_to_scalars(deep, ["jets_constituents_pt", "jets_constituents_eta"])
    return flat.select("event_id", r("jets_constituents_pt").alias("pt"), r("jets_constituents_eta").alias("eta"))


@query(
    "unpack_events_by_table_function",
    f"""SELECT event_id, pos::INT AS place, idx::INT AS place_2, jet_id AS jets_id, {R('pt')} AS pt, {R('eta')} AS eta
        FROM ejets JOIN lead USING (jet_id)""",
    ("ejets", "lead"),
)
def unpack_events_by_table_function(spark, d):
    """Both levels at once by a function that learns the columns from the table it is given."""
    flat = records.unpack_records(events_of_jets_of_constituents(spark, d), "jets_", 2, "place", ["event_id"])
    return flat.select(
        "event_id", "place", "place_2", "jets_id", r("jets_constituents_pt").alias("pt"), r("jets_constituents_eta").alias("eta")
    )


@query(
    "central_jet_flags",
    """WITH a AS (SELECT event_id, min(CASE WHEN pos = 0 THEN abs(jets_eta) END) AS e0,
            coalesce(min(CASE WHEN pos = 1 THEN abs(jets_eta) END), 'inf'::DOUBLE) AS e1 FROM ejets GROUP BY event_id)
        SELECT e.event_id, pos::INT AS jets_index, jet_id AS jets_id,
            (pos = CASE WHEN e1 < e0 THEN 1 ELSE 0 END)::INT AS jets_is_central
        FROM ejets e JOIN a ON e.event_id = a.event_id""",
    ("ejets",),
)
def central_jet_flags(spark, d):
    return jets_of(nested.central_jet_flags(events(spark, d)), "jets_id", "jets_is_central")


@query(
    "pad_node_arrays",
    f"""WITH g AS (SELECT jet_id, i FROM (SELECT DISTINCT jet_id FROM lead), range(6) x(i))
        SELECT g.jet_id, g.i::INT AS slot, {R('coalesce(pt, -999e0)')} AS pt, {R('coalesce(m, -999e0)')} AS m,
            pt IS NOT NULL AS mask FROM g LEFT JOIN lead l ON g.jet_id = l.jet_id AND g.i = l.idx""",
    ("lead",),
)
def pad_node_arrays(spark, d):
    df = tables.nested_constituents(spark, d).withColumn("node", merged(["Constituent"]))
    padded = nested.pad_records(df.select("jet_id", "node"), 6, -999.0, node="node")
    rows = padded.select("jet_id", F.posexplode(F.arrays_zip("node", "mask")).alias("slot", "x"))
    return rows.select(
        "jet_id", "slot", r("x.node.pt").alias("pt"), r("x.node.m").alias("m"), F.col("x.mask").alias("mask")
    )


@query(
    "padded_batches",
    f"""WITH j AS (SELECT jet_id, least(count(*), 6) AS n, sum(CASE WHEN idx < 6 THEN pt ELSE 0e0 END) AS pt FROM lead GROUP BY jet_id),
        b AS (SELECT *, (row_number() OVER (ORDER BY jet_id) - 1) // 128 AS batch FROM j)
        SELECT batch, count(*)::INT AS size, sum(n)::BIGINT AS real_slots, (6 * count(*))::BIGINT AS slots, {R('sum(pt)', 1)} AS pt
        FROM b GROUP BY batch""",
    ("lead",),
)
def padded_batches(spark, d):
    """Batches of jets padded to six constituents, with their masks."""
    df = tables.nested_constituents(spark, d).select("jet_id", merged(["Constituent"]).alias("node"))
    ready = JetDataset(df).prepare(128, "jet_id", ["node"], max_constituents=6, node="node").df
    slots = ready.select("batch", "size", F.flatten("node").alias("node"), F.flatten("mask").alias("mask"))
    real = F.filter(F.arrays_zip("node", "mask"), lambda x: x["mask"])
    pt = F.aggregate(real, F.lit(0.0), lambda s, x: s + x["node"]["pt"])
    return slots.select(
        "batch", "size", F.size(real).cast("long").alias("real_slots"), F.size("node").cast("long").alias("slots"),
        r(pt, 1).alias("pt"),
    )


@query(
    "pad_edge_matrices",
    f"""WITH a AS (SELECT a.jet_id, sum(a.pt + b.pt) AS s, count(*) AS n FROM lead a JOIN lead b
            ON a.jet_id = b.jet_id AND a.idx < 5 AND b.idx < 5 GROUP BY a.jet_id)
        SELECT jet_id, {R('s + (25 - n) * -1e0', 2)} AS total, 5::INT AS n_rows, 5::INT AS n_columns FROM a""",
    ("lead",),
)
def pad_edge_matrices(spark, d):
    c = F.col("node")
    df = tables.nested_constituents(spark, d).withColumn("node", merged(["Constituent"]))
    df = df.select("jet_id", F.transform(c, lambda a: F.transform(c, lambda b: a["pt"] + b["pt"])).alias("edge"))
    padded = nested.pad_records(df, 5, -1.0, edge="edge", mask=None)
    total = F.aggregate(F.flatten("edge"), F.lit(0.0), lambda acc, x: acc + x)
    return padded.select(
        "jet_id", r(total, 2).alias("total"), F.size("edge").alias("n_rows"), F.size(F.col("edge")[4]).alias("n_columns")
    )


def together(collections):
    """Collections of the same jets side by side; a jet that lacks one has empty arrays there."""
    joined = reduce(lambda a, b: a.join(b, "jet_id", "full"), collections)
    arrays = [f for f in joined.schema if f.name != "jet_id"]
    return joined.withColumns({f.name: F.coalesce(f.name, F.array().cast(f.dataType)) for f in arrays})


def two_collections(spark, d):
    """Constituents split by return flag into two collections of one jet."""
    rows = tables.constituents(spark, d)
    returned = tables.nested_constituents(spark, d, "Constituent", rows.where("l_returnflag = 'R'"))
    others = tables.nested_constituents(spark, d, "TopoTower", rows.where("l_returnflag <> 'R'"))
    return together([returned, others])


@query(
    "merge_collections_sorted",
    f"""WITH u AS (SELECT *, (l_returnflag <> 'R')::INT AS kind FROM cons),
        all_jets AS (SELECT jet_id FROM u GROUP BY jet_id),
        one AS (SELECT u.*, row_number() OVER (PARTITION BY jet_id, kind
            ORDER BY pt DESC, l_linenumber, l_partkey, l_suppkey, phi, eta, m) AS nth FROM u),
        o AS (SELECT one.*, row_number() OVER (PARTITION BY jet_id ORDER BY pt DESC, kind, nth) AS place FROM one)
        SELECT o.jet_id, (place - 1)::INT AS place, {R('pt')} AS pt, kind FROM o JOIN all_jets b ON o.jet_id = b.jet_id
        WHERE place <= 4""",
    ("cons",),
)
def merge_collections_sorted(spark, d):
    df = two_collections(spark, d).withColumn("all", merged(["Constituent", "TopoTower"], 4))
    return df.select("jet_id", F.posexplode("all").alias("place", "c")).select(
        "jet_id", "place", r("c.pt").alias("pt"), F.col("c.kind").alias("kind")
    )


@query(
    "sort_constituents_by_pt",
    f"""SELECT jet_id, (row_number() OVER (PARTITION BY jet_id ORDER BY abs(eta) DESC, pt DESC, l_linenumber, l_partkey,
        l_suppkey, phi, eta, m) - 1)::INT AS place, {R('abs(eta)')} AS key, {R('pt')} AS pt FROM lead""",
    ("lead",),
)
def sort_constituents_by_pt(spark, d):
    # the arrays come in pt order, so sort by another quantity to see the sort at work
    from sparkjets.functions.arrays import zip_columns
    from sparkjets.functions.constituents import by_descending_pt

    df = tables.nested_constituents(spark, d)
    boxed = F.transform(
        zip_columns({"e": "jets_Constituent_eta", "p": "jets_Constituent_pt"}),
        lambda x: F.struct(F.abs(x["e"]).alias("pt"), x["p"].alias("other")),
    )
    rows = df.select("jet_id", F.posexplode(by_descending_pt(boxed)).alias("place", "c"))
    return rows.select("jet_id", "place", r("c.pt").alias("key"), r("c.other").alias("pt"))


@query(
    "first_constituents",
    f"SELECT jet_id, count(*)::INT AS n, {R('sum(pt)', 2)} AS pt_sum FROM lead WHERE idx < 3 GROUP BY jet_id",
    ("lead",),
)
def first_constituents(spark, d):
    c = F.slice("jets_Constituent_pt", 1, 3)
    return tables.nested_constituents(spark, d).select(
        "jet_id", F.size(c).alias("n"), r(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 2).alias("pt_sum")
    )


@query("first_element_of_array", f"SELECT jet_id, {R('weight')} AS nominal FROM jets")
def first_element_of_array(spark, d):
    return tables.jets(spark, d).select("jet_id", r(F.get("weight_mc", F.lit(0))).alias("nominal"))


# -------------------------------------------------------------- four-vectors


@query(
    "vector_to_cartesian",
    f"""WITH p AS (SELECT *, pt*cos(phi) AS px, pt*sin(phi) AS py, pt*sinh(eta) AS pz FROM cons)
        SELECT count(*) AS n, {R('sum(sqrt(m*m + px*px + py*py + pz*pz))', 2)} AS e, {R('sum(px)', 2)} AS px,
            {R('sum(py)', 2)} AS py, {R('sum(pz)', 2)} AS pz, l_returnflag AS flag FROM p GROUP BY l_returnflag""",
    ("cons",),
)
def vector_to_cartesian(spark, d):
    c = tables.constituents(spark, d)
    p = vectors.cartesian(*[F.col(k) for k in ("m", "pt", "eta", "phi")])
    return c.groupBy(F.col("l_returnflag").alias("flag")).agg(
        F.count("*").alias("n"),
        r(F.sum(p["E"]), 2).alias("e"),
        *[r(F.sum(p[k]), 2).alias(k) for k in ("px", "py", "pz")],
    )


def _cartesian_rows(spark, d):
    p = vectors.cartesian(*[F.col(k) for k in ("m", "pt", "eta", "phi")])
    keys = ["jet_id", "l_linenumber", "l_partkey", "l_suppkey"]
    return tables.constituents(spark, d).select(*keys, *[v.alias(k) for k, v in p.items()])


@query(
    "vector_to_cylindrical",
    f"""SELECT jet_id, l_linenumber, l_partkey, l_suppkey, {R('pt', 4)} AS pt, {R('eta', 5)} AS eta,
        {R('atan2(sin(phi), cos(phi))', 5)} AS phi FROM cons""",
    ("cons",),
)
def vector_to_cylindrical(spark, d):
    v = vectors.cylindrical(*[F.col(k) for k in ("E", "px", "py", "pz")])
    return _cartesian_rows(spark, d).select(
        "jet_id", "l_linenumber", "l_partkey", "l_suppkey",
        r(v["pt"], 4).alias("pt"), r(v["eta"], 5).alias("eta"), r(v["phi"], 5).alias("phi"),
    )


@query(
    "vector_to_rapidity",
    f"""WITH p AS (SELECT *, pt*sinh(eta) AS pz, sqrt(m*m + pt*pt*cosh(eta)*cosh(eta)) AS e FROM cons)
        SELECT jet_id, l_linenumber, l_partkey, l_suppkey, {R('0.5e0 * ln((e + pz) / (e - pz))', 5)} AS y FROM p""",
    ("cons",),
)
def vector_to_rapidity(spark, d):
    v = vectors.cylindrical_rapidity(*[F.col(k) for k in ("E", "px", "py", "pz")])
    return _cartesian_rows(spark, d).select(
        "jet_id", "l_linenumber", "l_partkey", "l_suppkey", r(v["y"], 5).alias("y")
    )


@query(
    "wrapped_delta_phi",
    f"""SELECT jet_id, l_linenumber, l_partkey, l_suppkey, {R('pi() - abs(abs(phi - jets_phi) - pi())', 5)} AS dphi
        FROM (SELECT c.*, jets_phi FROM cons c JOIN jets j USING (jet_id))""",
    ("cons", "jets"),
)
def wrapped_delta_phi(spark, d):
    rows = tables.constituents(spark, d).join(tables.jets(spark, d).select("jet_id", "jets_phi"), "jet_id")
    return rows.select(
        "jet_id", "l_linenumber", "l_partkey", "l_suppkey",
        r(F.abs(vectors.delta_phi(F.col("phi"), F.col("jets_phi"))), 5).alias("dphi"),
    )


# --------------------------------------------------- pairs and neighbours


def numbered_constituents(spark, d):
    """Constituents as rows, numbered from zero in each jet by descending pt."""
    order = [F.col("pt").desc(), *[F.col(c) for c in tables.CONSTITUENT_ORDER[1:]]]
    at = F.row_number().over(Window.partitionBy("jet_id").orderBy(*order)) - 1
    return tables.constituents(spark, d).withColumn("idx", at)


@query(
    "nearest_neighbours",
    f"""WITH p AS (SELECT a.jet_id, a.idx AS i, b.idx AS j,
            sqrt((a.eta-b.eta)*(a.eta-b.eta) + (a.phi-b.phi)*(a.phi-b.phi)) AS dist FROM lead a JOIN lead b USING (jet_id)),
        q AS (SELECT *, row_number() OVER (PARTITION BY jet_id, i ORDER BY round(dist, 9), j) AS k FROM p)
        SELECT jet_id, i::INT AS i, (k - 1)::INT AS nth, {R('dist', 5)} AS distance FROM q WHERE k BETWEEN 2 AND 4""",
    ("lead",),
)
def nearest_neighbours(spark, d):
    near = neighbours.nearest_rows(numbered_constituents(spark, d), ["jet_id"], "idx", 3)
    return near.select("jet_id", F.col("i").cast("int").alias("i"), "nth", r("distance", 5).alias("distance"))


@query(
    "neighbour_edge_features",
    f"""WITH q AS (SELECT a.jet_id, a.idx AS i, a.pt AS pt_a, b.pt AS pt_b, row_number() OVER (PARTITION BY a.jet_id, a.idx
            ORDER BY abs(a.pt - b.pt), b.idx) AS k FROM lead a JOIN lead b USING (jet_id))
        SELECT jet_id, i::INT AS i, {R('pt_a', 3)} AS pt_centre, {R('abs(pt_b - pt_a)', 3)} AS pt_diff FROM q WHERE k = 2""",
    ("lead",),
)
def neighbour_edge_features(spark, d):
    rows = numbered_constituents(spark, d)
    near = neighbours.nearest_rows(rows, ["jet_id"], "idx", 1, ["pt"])
    edges = neighbours.edge_rows(near, rows, ["jet_id"], "idx", ["pt"])
    return edges.select("jet_id", F.col("i").cast("int").alias("i"), r("pt_centre", 3).alias("pt_centre"), r(F.abs("pt_diff"), 3).alias("pt_diff"))


HIT_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "neighbours_of_all_hits",
    f"""WITH h AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY {', '.join(HIT_ORDER)}) AS i,
            l_quantity AS x, l_extendedprice / 1000e0 AS y FROM lineitem),
        q AS (SELECT a.l_suppkey, a.i, b.i AS j, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) AS dist FROM h a JOIN h b USING (l_suppkey)),
        k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, i ORDER BY dist, j) - 1 AS nth FROM q)
        SELECT l_suppkey, i, nth::INT AS nth, {R('dist', 6)} AS distance FROM k WHERE nth BETWEEN 1 AND 2""",
    (),
)
def neighbours_of_all_hits(spark, d):
    """Two nearest neighbours of every item among those of its supplier: large groups, which take the grid of cells."""
    order = Window.partitionBy("l_suppkey").orderBy(*HIT_ORDER)
    rows = tables.table(spark, d, "lineitem").select(
        "l_suppkey", F.row_number().over(order).alias("i"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000.0).alias("y")
    )
    near = neighbours.nearest_rows(rows, ["l_suppkey"], "i", 2, ["x", "y"])
    return near.select("l_suppkey", F.col("i").cast("long").alias("i"), "nth", r("distance", 6).alias("distance"))
