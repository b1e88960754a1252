"""Feature sets, pair matrices, augmentations, feature statistics, scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkjets.catalog.aggregations import ETA, PT
from sparkjets.catalog.arrays import together, two_collections
from sparkjets.catalog.base import R, case_bins, draw, normal_draw, query, r
from sparkjets.functions import features, vectors
from sparkjets.functions.arrays import explode_items, total
from sparkjets.functions.augment import augment
from sparkjets.functions.constituents import merged
from sparkjets.operators import information, metrics, nested, pair_tiles, pairs, rank, scoring, split
from sparkjets.operators.nested import nest
from sparkjets.plans.training import training_table
from sparkjets.sources import tables

jets = tables.jets


def ln(x: str) -> str:
    """SQL: logarithm after clamping."""
    return f"ln(least(greatest({x}, 1e-10), 1e10))"


def node_rows(df, set_name: str, names: list[str], digits: int = 6, field: str = "node", **options):
    """Per-constituent features as rows; ``names`` become f0, f1, ..."""
    out = features.add_features(df, set_name, **options)
    rows = explode_items(out, ["jet_id"], F.col("features")[field], "n", "idx")
    return rows.select("jet_id", "idx", *[r(F.col("n")[c], digits).alias(f"f{i}") for i, c in enumerate(names)])


# ------------------------------------------------------------- whole-jet sets


def _derived(i: int):
    return ((F.col("jet_id") * (i + 3)) % (i + 7)).cast("double")


def _derived_sql(i: int) -> str:
    return f"((jet_id * {i + 3}) % {i + 7})::DOUBLE"


def with_derived(df, names, arrays=()):
    """Stand-ins for detector columns that the test tables do not have."""
    made = {c: _derived(i) for i, c in enumerate(names) if c not in df.columns}
    made |= {c: F.array(_derived(50 + i), F.lit(-1.0)) for i, c in enumerate(arrays)}
    return df.withColumns(made)


FULL = [*features.FULL_HIGHLEVEL, "jets_Constituent_n"]
OWN = {"jets_pt", "jets_eta", "jets_phi", "jets_m"}


def _sum_sql(names, arrays=()):
    parts = [f"{k + 1} * {c if c in OWN else _derived_sql(i)}" for k, (i, c) in enumerate(enumerate(names))]
    parts += [f"{len(names) + k + 1} * {_derived_sql(50 + k)}" for k in range(len(arrays))]
    return " + ".join(parts)


def _sum_features(names):
    result = F.lit(0.0)
    for k, name in enumerate(names):
        result = result + F.col("features")[name] * (k + 1)
    return result


@query("features_full_highlevel", f"SELECT jet_id, 33::INT AS width, {R(_sum_sql(FULL, features.FULL_HIGHLEVEL_FIRST), 3)} AS mix FROM jets")
def features_full_highlevel(spark, d):
    df = with_derived(jets(spark, d), FULL, features.FULL_HIGHLEVEL_FIRST)
    out = features.add_features(df, "full_highlevel")
    names = [f.name for f in out.schema["features"].dataType.fields]
    return out.select("jet_id", F.lit(len(names)).alias("width"), r(_sum_features(names), 3).alias("mix"))


@query("features_highlevel", f"SELECT jet_id, 8::INT AS width, {R(_sum_sql(features.HIGHLEVEL, features.HIGHLEVEL_FIRST), 3)} AS mix FROM jets")
def features_highlevel(spark, d):
    df = with_derived(jets(spark, d), features.HIGHLEVEL, features.HIGHLEVEL_FIRST)
    out = features.add_features(df, "highlevel")
    names = [f.name for f in out.schema["features"].dataType.fields]
    return out.select("jet_id", F.lit(len(names)).alias("width"), r(_sum_features(names), 3).alias("mix"))


NO_ETA = [c for c in features.HIGHLEVEL if c != "jets_eta"]


@query("features_highlevel_no_eta", f"SELECT jet_id, 7::INT AS width, {R(_sum_sql(NO_ETA, features.HIGHLEVEL_FIRST), 3)} AS mix FROM jets")
def features_highlevel_no_eta(spark, d):
    df = with_derived(jets(spark, d), NO_ETA, features.HIGHLEVEL_FIRST)
    out = features.add_features(df, "highlevel_no_eta")
    names = [f.name for f in out.schema["features"].dataType.fields]
    return out.select("jet_id", F.lit(len(names)).alias("width"), r(_sum_features(names), 3).alias("mix"))


@query("features_jetclass_highlevel", f"SELECT jet_id, 10::INT AS width, {R(_sum_sql(features.JETCLASS_HIGHLEVEL), 3)} AS mix FROM jets")
def features_jetclass_highlevel(spark, d):
    out = features.add_features(with_derived(jets(spark, d), features.JETCLASS_HIGHLEVEL), "jet_class_highlevel")
    names = [f.name for f in out.schema["features"].dataType.fields]
    return out.select("jet_id", F.lit(len(names)).alias("width"), r(_sum_features(names), 3).alias("mix"))


CRAFTED = """WITH w AS (SELECT jet_id, count(*)::DOUBLE AS n, sum(pt) AS s, sum(pt * sqrt((jets_eta - eta) * (jets_eta - eta)
        + (jets_phi - phi) * (jets_phi - phi))) AS ptdr FROM lead JOIN jets USING (jet_id) GROUP BY jet_id),
    c AS (SELECT a.jet_id, sum(CASE WHEN a.idx <> b.idx THEN a.pt * b.pt * pow(sqrt((a.eta - b.eta) * (a.eta - b.eta)
        + (a.phi - b.phi) * (a.phi - b.phi)), 0.2e0) ELSE 0 END) AS c FROM lead a JOIN lead b USING (jet_id) GROUP BY a.jet_id)"""


@query(
    "features_crafted_highlevel",
    f"""{CRAFTED} SELECT jet_id, {R('jets_pt')} AS pt, {R('jets_eta')} AS eta, coalesce(n, 0e0) AS n, {R('ptdr / s')} AS width, {R('c / (s * s)')} AS c1
        FROM jets LEFT JOIN w USING (jet_id) LEFT JOIN c USING (jet_id)""",
    ("lead", "jets"),
)
def features_crafted_highlevel(spark, d):
    f = F.col("features")
    out = features.add_features(tables.jets_nested(spark, d), "crafted_highlevel")
    return out.select(
        "jet_id", r(f["pt_jet"]).alias("pt"), r(f["eta_jet"]).alias("eta"), f["N_PFO"].alias("n"),
        r(f["W_PFO_jet"]).alias("width"), r(f["C1_PFO_jet"]).alias("c1"),
    )


@query(
    "features_crafted_no_eta",
    f"""{CRAFTED} SELECT jet_id, 4::INT AS fields, coalesce(n, 0e0) AS n, {R('ptdr / s')} AS width, {R('c / (s * s)')} AS c1
        FROM jets LEFT JOIN w USING (jet_id) LEFT JOIN c USING (jet_id)""",
    ("lead", "jets"),
)
def features_crafted_no_eta(spark, d):
    f = F.col("features")
    out = features.add_features(tables.jets_nested(spark, d), "crafted_highlevel_no_eta")
    fields = len(out.schema["features"].dataType.fields)
    return out.select(
        "jet_id", F.lit(fields).alias("fields"), f["N_PFO"].alias("n"), r(f["W_PFO_jet"]).alias("width"),
        r(f["C1_PFO_jet"]).alias("c1"),
    )


# --------------------------------------------------------- constituent sets

CONST = ["log_pT", "log_PT|PTjet", "log_E", "log_E|Ejet", "deltaEta", "deltaPhi", "deltaR", "m"]
REL = ["log_PT|PTjet", "log_E|Ejet", "deltaEta", "deltaPhi", "deltaR", "m"]
CONST_EXPRESSIONS = [
    ln("pt"),
    ln("pt / jets_pt"),
    ln("sqrt(pt*pt + m*m)"),
    ln("sqrt(pt*pt + m*m) / sqrt(jets_pt*jets_pt + jets_m*jets_m)"),
    "eta - jets_eta",
    "phi - jets_phi",
    "sqrt((eta - jets_eta)*(eta - jets_eta) + (phi - jets_phi)*(phi - jets_phi))",
    ln("m"),
]
CONST_SQL = ", ".join(f"{R(x)} AS f{i}" for i, x in enumerate(CONST_EXPRESSIONS))
BASE = f"SELECT jet_id, idx::INT AS idx, {CONST_SQL} FROM lead JOIN jets USING (jet_id)"


@query("features_const", BASE, ("lead", "jets"))
def features_const(spark, d):
    return node_rows(tables.jets_nested(spark, d), "const", CONST)


@query("features_int_const_node", BASE, ("lead", "jets"))
def features_int_const_node(spark, d):
    return node_rows(tables.jets_nested(spark, d), "int_const", CONST)


# momenta, the re-summed axis, and constituents relative to it
AXIS = """p AS (SELECT *, pt*cos(phi) AS px, pt*sin(phi) AS py, pt*sinh(eta) AS pz,
        sqrt(m*m + pt*cos(phi)*pt*cos(phi) + pt*sin(phi)*pt*sin(phi) + pt*sinh(eta)*pt*sinh(eta)) AS e FROM lead),
    s AS (SELECT jet_id, sum(px) AS sx, sum(py) AS sy, sum(pz) AS sz, sum(e) AS se FROM p GROUP BY jet_id),
    ax AS (SELECT jet_id, sqrt(sx*sx + sy*sy) AS apt, asinh(sz / sqrt(sx*sx + sy*sy)) AS aeta, atan2(sy, sx) AS aphi, se FROM s),
    q AS (SELECT p.jet_id, idx, p.m, pt / apt AS pt, eta - aeta AS eta, phi - aphi AS phi, e / apt AS e, px / apt AS px, py / apt AS py,
        pz / apt AS pz, e / se AS share, apt, aeta, aphi FROM p JOIN ax USING (jet_id))"""


@query(
    "features_rel_const",
    f"""WITH {AXIS} SELECT jet_id, idx::INT AS idx, {R(ln('pt / apt'))} AS f0, {R(ln('e / sqrt(apt*apt + jets_m*jets_m)'))} AS f1,
        {R('eta - aeta', 5)} AS f2, {R('phi - aphi', 5)} AS f3,
        {R('sqrt((eta - aeta)*(eta - aeta) + (phi - aphi)*(phi - aphi))', 5)} AS f4, {R(ln('m'))} AS f5 FROM q JOIN jets USING (jet_id)""",
    ("lead", "jets"),
)
def features_rel_const(spark, d):
    out = node_rows(tables.jets_nested(spark, d), "rel_const", REL, 12)
    return out.select("jet_id", "idx", *[r(f"f{i}", 5 if i in (2, 3, 4) else 6).alias(f"f{i}") for i in range(6)])


@query(
    "features_gnn_padded",
    f"""WITH g AS (SELECT jet_id, i FROM jets, range(8) x(i)), b AS ({BASE})
        SELECT g.jet_id, g.i::INT AS idx, coalesce(f0, 0e0) AS log_pt, coalesce(f4, 0e0) AS deta, coalesce(f5, 0e0) AS dphi,
            (f0 IS NOT NULL)::INT::DOUBLE AS mask FROM g LEFT JOIN b ON g.jet_id = b.jet_id AND g.i = b.idx""",
    ("lead", "jets"),
)
def features_gnn_padded(spark, d):
    out = features.add_features(tables.jets_nested(spark, d), "gnn", max_constituents=8)
    parts = out.select("jet_id", "features.points", "features.node", "features.mask")
    rows = parts.select("jet_id", F.posexplode(F.arrays_zip("points", "node", "mask")).alias("idx", "x"))
    return rows.select(
        "jet_id", "idx", r("x.node.log_pT").alias("log_pt"), r("x.points.deltaEta").alias("deta"),
        r("x.points.deltaPhi").alias("dphi"), F.col("x.mask").alias("mask"),
    )


@query(
    "features_irc_safe",
    f"""SELECT jet_id, idx::INT AS idx, {R('eta - jets_eta')} AS deta, {R('phi - jets_phi')} AS dphi, {R('pt / jets_pt')} AS pt_share
        FROM lead JOIN jets USING (jet_id)""",
    ("lead", "jets"),
)
def features_irc_safe(spark, d):
    out = features.add_features(tables.jets_nested(spark, d), "irc_safe")
    both = out.select("jet_id", F.col("features.angular").alias("a"), F.col("features.energy").alias("e"))
    rows = both.select("jet_id", F.posexplode(F.arrays_zip("a", "e")).alias("idx", "x"))
    return rows.select(
        "jet_id", "idx", r("x.a.deltaEta").alias("deta"), r("x.a.deltaPhi").alias("dphi"),
        r(F.col("x.e")["PT|PTjet"]).alias("pt_share"),
    )


INT_REL = """SELECT jet_id, idx::INT AS idx, {f0} AS f0, {f1} AS f1, {f2} AS f2, {f3} AS f3, {f4} AS f4, {f5} AS f5 FROM q"""


def _int_rel_sql(energy: str, mass: str) -> str:
    return f"WITH {AXIS} " + INT_REL.format(
        f0=R(ln("pt"), 5), f1=R(ln(energy), 5), f2=R("eta", 5), f3=R("phi", 5), f4=R("sqrt(eta*eta + phi*phi)", 5), f5=R(mass, 5)
    )


@query("features_int_rel_const_node", _int_rel_sql("e", ln("m")), ("lead",))
def features_int_rel_const_node(spark, d):
    return node_rows(tables.jets_nested(spark, d), "int_rel_const", REL, 5)


@query("features_int_rel_const2_node", _int_rel_sql("share", "m"), ("lead",))
def features_int_rel_const2_node(spark, d):
    return node_rows(tables.jets_nested(spark, d), "int_rel_const2", REL, 5)


# ------------------------------------------------------------- pair matrices
# The logarithm of a pair mass that is zero up to rounding is noise, so masses
# count only above a floor in both engines.


def _pair_sql(
    source: str, floor: float, angle: str = "eta", wrap: bool = False, log_z: bool = False, jets: str = "jets"
) -> str:
    dphi = "atan2(sin(a.phi - b.phi), cos(a.phi - b.phi))" if wrap else "(a.phi - b.phi)"
    z = "least(a.pt, b.pt) / (a.pt + b.pt)"
    return f"""pr AS (SELECT a.jet_id, {ln(f'sqrt((a.{angle} - b.{angle})*(a.{angle} - b.{angle}) + {dphi}*{dphi})')} AS delta,
            {ln(f'least(a.pt, b.pt) * sqrt((a.{angle} - b.{angle})*(a.{angle} - b.{angle}) + {dphi}*{dphi})')} AS kt,
            {ln(z) if log_z else z} AS z, {ln('(a.e+b.e)*(a.e+b.e) - (a.px+b.px)*(a.px+b.px) - (a.py+b.py)*(a.py+b.py) - (a.pz+b.pz)*(a.pz+b.pz)')} AS m2
            FROM {source} a JOIN {source} b ON a.jet_id = b.jet_id AND a.idx <> b.idx)
        SELECT n.jet_id, n.n AS cells, {R('coalesce(sum(CASE WHEN delta > -8e0 THEN delta END), 0e0)', 3)} AS delta,
            {R('coalesce(sum(CASE WHEN delta > -8e0 THEN kt END), 0e0)', 3)} AS k_t,
            {R('coalesce(sum(z), 0e0)', 4)} AS z, {R(f'coalesce(sum(CASE WHEN m2 > {floor!r}::DOUBLE THEN m2 END), 0e0)', 2)} AS m2
        FROM (SELECT jet_id, count(idx) * count(idx) AS n FROM (SELECT DISTINCT jet_id FROM {jets}) LEFT JOIN (SELECT jet_id, idx
            FROM lead) USING (jet_id) GROUP BY jet_id) n LEFT JOIN pr USING (jet_id) GROUP BY n.jet_id, n.n"""


def pair_sums(df, floor: float):
    """Per jet: matrix size and sums over the off-diagonal cells, without leaving the row."""
    cells = F.flatten(
        F.transform(
            "features.edge",
            lambda row, i: F.transform(row, lambda c, j: F.struct(c.alias("c"), (i != j).alias("off"))),
        )
    )
    df = df.select("jet_id", cells.alias("cells"))

    def add(name, keep):
        return total(F.filter("cells", lambda x: x["off"] & keep(x["c"])), lambda x: x["c"][name])

    far = lambda c: c["delta"] > -8.0
    return df.select(
        "jet_id",
        F.size("cells").cast("long").alias("cells"),
        r(add("delta", far), 3).alias("delta"),
        r(add("k_t", far), 3).alias("k_t"),
        r(add("z", lambda c: F.lit(True)), 4).alias("z"),
        r(add("m2", lambda c: c["m2"] > floor), 2).alias("m2"),
    )


PLAIN = """p AS (SELECT *, pt*cos(phi) AS px, pt*sin(phi) AS py, pt*sinh(eta) AS pz,
    sqrt(m*m + pt*cos(phi)*pt*cos(phi) + pt*sin(phi)*pt*sin(phi) + pt*sinh(eta)*pt*sinh(eta)) AS e FROM lead)"""


#: Sums over the off-diagonal cells of a jet: feature, and the floor its guard must pass.
def _sums(floor: float) -> dict:
    return {"delta": ("delta", "delta", -8.0), "k_t": ("k_t", "delta", -8.0), "z": ("z", None, 0.0), "m2": ("m2", "m2", floor)}


def tiled_sums(whole, rows, name: str, floor: float, engine: str = "arrow"):
    """Per jet of ``whole`` the sums over all pairs of its constituents, whatever their number."""
    options = dict(pair_tiles.PAIR_SETS[name])
    made = pair_tiles.tiles(rows, ["jet_id"], CONSTITUENT_IDS, options.pop("axis", False), options.pop("angle", "eta"))
    out = whole.select("jet_id").join(pair_tiles.pair_sums(made, ["jet_id"], _sums(floor), engine=engine, **options), "jet_id", "left")
    digits = {"delta": 3, "k_t": 3, "z": 4, "m2": 2}
    return out.select(
        "jet_id",
        F.coalesce("cells", F.lit(0)).cast("long").alias("cells"),
        *[r(F.coalesce(n, F.lit(0.0)), k).alias(n) for n, k in digits.items()],
    )


#: Tell the constituents of a jet apart.
CONSTITUENT_IDS = ["l_linenumber", "l_partkey", "l_suppkey", "pt", "m"]


def constituent_rows(spark, d):
    return pair_tiles.with_momenta(tables.constituents(spark, d))


@query("pair_matrix_int_const", f"WITH {PLAIN}, {_pair_sql('p', 14.0)}", ("lead", "jets"))
def pair_matrix_int_const(spark, d):
    return tiled_sums(jets(spark, d), constituent_rows(spark, d), "int_const", 14.0)


@query("pair_matrix_builtin_engine", f"WITH {PLAIN}, {_pair_sql('p', 14.0)}", ("lead", "jets"))
def pair_matrix_builtin_engine(spark, d):
    return tiled_sums(jets(spark, d), constituent_rows(spark, d), "int_const", 14.0, engine="builtin")


@query("pair_matrix_int_rel_const", f"WITH {AXIS}, {_pair_sql('q', -6.0)}", ("lead", "jets"))
def pair_matrix_int_rel_const(spark, d):
    return tiled_sums(jets(spark, d), constituent_rows(spark, d), "int_rel_const", -6.0)


@query("pair_matrix_int_rel_const2", f"WITH {AXIS}, {_pair_sql('q', -6.0)}", ("lead", "jets"))
def pair_matrix_int_rel_const2(spark, d):
    return tiled_sums(jets(spark, d), constituent_rows(spark, d), "int_rel_const2", -6.0)


@query("pair_matrix_first_constituents", f"WITH {PLAIN}, {_pair_sql('p', 14.0)}".replace("FROM lead", "FROM first5"), ("first5", "jets"))
def pair_matrix_first_constituents(spark, d):
    """The matrix in the row of its jet, asked for with the first five constituents only."""
    return pair_sums(features.add_features(tables.jets_nested(spark, d), "int_const", max_constituents=5), 14.0)


@query(
    "pair_cells",
    f"""WITH {PLAIN} SELECT a.jet_id, a.l_linenumber::BIGINT AS i, b.l_linenumber::BIGINT AS j,
        {R('CASE WHEN a.idx = b.idx THEN 0e0 ELSE least(a.pt, b.pt) / (a.pt + b.pt) END', 5)} AS z,
        {R(f"CASE WHEN a.idx = b.idx THEN 0e0 ELSE {ln('sqrt((a.eta - b.eta)*(a.eta - b.eta) + (a.phi - b.phi)*(a.phi - b.phi))')} END", 4)} AS delta
        FROM p a JOIN p b USING (jet_id)""",
    ("lead",),
)
def pair_cells(spark, d):
    """Every cell of every jet as a row."""
    made = pair_tiles.tiles(constituent_rows(spark, d), ["jet_id"], CONSTITUENT_IDS, index="l_linenumber")
    return pair_tiles.pair_cells(made, ["jet_id"]).select("jet_id", "i", "j", r("z", 5).alias("z"), r("delta", 4).alias("delta"))


# --------------------------------------------------------------- JetClass sets


def jetclass_input(spark, d):
    """Constituents with Cartesian momenta, particle flags and displacements, in the JetClass layout."""
    p = vectors.cartesian(*[F.col(k) for k in ("m", "pt", "eta", "phi")])
    rows = tables.constituents(spark, d).withColumns(
        {
            "part_energy": p["E"], "part_px": p["px"], "part_py": p["py"], "part_pz": p["pz"],
            "part_charge": (F.col("l_linenumber") % 3 - 1).cast("double"),
            "part_isElectron": (F.col("l_linenumber") == 1).cast("double"),
            "part_isMuon": (F.col("l_linenumber") == 2).cast("double"),
            "part_isPhoton": (F.col("l_linenumber") == 3).cast("double"),
            "part_isNeutralHadron": (F.col("l_linenumber") == 4).cast("double"),
            "part_isChargedHadron": (F.col("l_linenumber") > 4).cast("double"),
            "part_d0val": (F.col("l_partkey") % 7).cast("double") / 7.0,
            "part_d0err": (F.col("l_partkey") % 5).cast("double"),
            "part_dzval": (F.col("l_suppkey") % 11).cast("double") / 11.0,
            "part_dzerr": (F.col("l_suppkey") % 3).cast("double"),
        }
    )
    names = [c for c in rows.columns if c.startswith("part_")]
    order = [F.col("pt").desc(), *[F.col(c) for c in tables.CONSTITUENT_ORDER[1:]]]
    arrays = nest(rows, ["jet_id"], order, {n: n for n in names})
    whole = jets(spark, d).select(
        "jet_id",
        F.col("jets_pt").alias("jet_pt"),
        F.col("jets_eta").alias("jet_eta"),
        F.col("jets_phi").alias("jet_phi"),
        (F.col("jets_pt") * 1.5).alias("jet_energy"),
    )
    return whole.join(arrays, "jet_id")


JETCLASS = f"""WITH {PLAIN} SELECT jet_id, idx::INT AS idx, {R(ln('pt'), 5)} AS f0, {R(ln('pt / jets_pt'), 5)} AS f1, {R(ln('e'), 5)} AS f2,
    {R(ln('e / (jets_pt * 1.5e0)'), 5)} AS f3, {R('eta - jets_eta', 5)} AS f4, {R('abs(atan2(sin(phi - jets_phi), cos(phi - jets_phi)))', 5)} AS f5,
    {R('(l_linenumber % 3 - 1)::DOUBLE', 5)} AS f6, (l_linenumber = 2)::INT::DOUBLE AS f7, {R('tanh((l_partkey % 7)::DOUBLE / 7e0)', 5)} AS f8,
    (l_suppkey % 3)::DOUBLE AS f9 FROM p JOIN jets USING (jet_id)"""
JETCLASS_NAMES = [
    "log_pT", "log_PT|PTjet", "log_E", "log_E|Ejet", "deltaEta", "deltaPhi", "charge", "is_muon", "tanh_d0", "dz_err",
]


def _jetclass_rows(spark, d, name):
    out = node_rows(jetclass_input(spark, d), name, JETCLASS_NAMES, 12)
    return out.select("jet_id", "idx", *[r(F.abs("f5") if i == 5 else F.col(f"f{i}"), 5).alias(f"f{i}") for i in range(10)])


@query("features_jetclass_node", JETCLASS, ("lead", "jets"))
def features_jetclass_node(spark, d):
    return _jetclass_rows(spark, d, "jet_class")


@query("features_jetclass_non_int", JETCLASS, ("lead", "jets"))
def features_jetclass_non_int(spark, d):
    return _jetclass_rows(spark, d, "jet_class_non_int")


@query(
    "features_jetclass_pnet_points",
    f"""WITH {PLAIN} SELECT jet_id, idx::INT AS idx, {R('eta - jets_eta', 5)} AS f0 FROM p JOIN jets USING (jet_id)""",
    ("lead", "jets"),
)
def features_jetclass_pnet_points(spark, d):
    return node_rows(jetclass_input(spark, d), "jet_class_pnet", ["deltaEta"], 5, field="points")


@query(
    "pair_matrix_jetclass",
    f"WITH {PLAIN}, y AS (SELECT *, 0.5e0 * ln((e + pz) / (e - pz)) AS rapidity FROM p), {_pair_sql('y', 14.0, 'rapidity', True, True, 'lead')}",
    ("lead",),
)
def pair_matrix_jetclass(spark, d):
    p = vectors.cylindrical_rapidity(*[F.col(k) for k in ("E", "px", "py", "pz")])
    rows = constituent_rows(spark, d).withColumns({k: p[k] for k in ("pt", "y", "phi")})
    return tiled_sums(rows.select("jet_id").distinct(), rows, "jet_class", 14.0)


# ----------------------------------------------- several constituent collections

KINDS = """u AS (SELECT *, (CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) AS kind FROM cons)"""
# all collections together, highest pt first
LEADING = """SELECT * FROM (SELECT u.*, row_number() OVER (PARTITION BY jet_id ORDER BY pt DESC, kind, l_linenumber, l_partkey,
        l_suppkey, phi, eta, m) AS place FROM u JOIN ok USING (jet_id))"""
TWO = f"""u AS (SELECT *, (l_returnflag <> 'R')::INT AS kind FROM cons),
    ok AS (SELECT jet_id FROM u GROUP BY jet_id),
    x AS ({LEADING})"""


def all_jets(whole, arrays):
    """Jets with their arrays; a jet without constituents has empty ones."""
    joined = whole.join(arrays, "jet_id", "left")
    return joined.withColumns({f.name: F.coalesce(f.name, F.array().cast(f.dataType)) for f in arrays.schema if f.name != "jet_id"})


def topo_jets(spark, d):
    return all_jets(jets(spark, d), two_collections(spark, d))


def _sums_sql(values, source: str) -> str:
    """Per jet, also one without constituents: how many, and the sum of every value over them."""
    sums = ", ".join(f"{R(f'coalesce(sum({x}) FILTER (WHERE s.pt IS NOT NULL), 0e0)', 4)} AS f{i}" for i, x in enumerate(values))
    return f"""SELECT j.jet_id, n, {', '.join(f'f{i}' for i in range(len(values)))} FROM (SELECT jet_id, count(s.pt) AS n, {sums}
        FROM (SELECT jet_id, jets_pt, jets_eta, jets_phi, jets_m FROM jets) j LEFT JOIN {source} s USING (jet_id) GROUP BY jet_id) j"""


def _of_kind(*kinds: int) -> list[str]:
    return [f"(s.kind = {k})::INT" for k in kinds]


def node_sums(df, set_name, names, digits=4, field="node", **options):
    """Per jet: constituents and the sum of some of their features."""
    out = features.add_features(df, set_name, **options)
    node = F.col("features")[field]
    return out.select(
        "jet_id",
        F.size(node).cast("long").alias("n"),
        *[r(total(node, lambda x, c=c: x[c]), digits).alias(f"f{i}") for i, c in enumerate(names)],
    )


@query("features_const_topo", f"WITH {TWO} {_sums_sql([*CONST_EXPRESSIONS, 'kind'], 'x')}", ("cons", "jets"))
def features_const_topo(spark, d):
    return node_sums(topo_jets(spark, d), "const_topo", [*CONST, "is_TopoTower"])


@query("features_int_const_topo", f"WITH {TWO} {_sums_sql([*CONST_EXPRESSIONS, 'kind'], 'x')}", ("cons", "jets"))
def features_int_const_topo(spark, d):
    return node_sums(topo_jets(spark, d), "int_const_topo", [*CONST, "is_TopoTower"])


def topo_axis(source: str) -> str:
    return f"""p AS (SELECT *, pt*cos(phi) AS px, pt*sin(phi) AS py, pt*sinh(eta) AS pz, sqrt(m*m + pt*pt*cosh(eta)*cosh(eta)) AS e FROM {source}),
    s AS (SELECT jet_id, sum(px) AS sx, sum(py) AS sy, sum(pz) AS sz, sum(e) AS se FROM p GROUP BY jet_id),
    q AS (SELECT p.*, sqrt(sx*sx + sy*sy) AS apt, asinh(sz / sqrt(sx*sx + sy*sy)) AS aeta, atan2(sy, sx) AS aphi, se FROM p JOIN s USING (jet_id))"""


def _rel_sql(energy: str, mass: str, kinds: list[str]) -> list[str]:
    return [ln("pt / apt"), ln(energy), "eta - aeta", "phi - aphi", "sqrt((eta - aeta)*(eta - aeta) + (phi - aphi)*(phi - aphi))", mass, *kinds]


#: This set takes its input relative to the axis and then once more.
REL_TWICE = [
    ln("pt / apt / apt"), ln("e / apt / sqrt(apt*apt + jets_m*jets_m)"), "eta - aeta - aeta", "phi - aphi - aphi",
    "sqrt((eta - aeta - aeta)*(eta - aeta - aeta) + (phi - aphi - aphi)*(phi - aphi - aphi))", ln("m"), "kind",
]


@query("features_rel_const_topo", f"WITH {TWO}, {topo_axis('x')} {_sums_sql(REL_TWICE, 'q')}", ("cons", "jets"))
def features_rel_const_topo(spark, d):
    return node_sums(topo_jets(spark, d), "rel_const_topo", [*REL, "is_TopoTower"])


@query("features_int_rel_const_topo", f"WITH {TWO}, {topo_axis('x')} {_sums_sql(_rel_sql('e / apt', ln('m'), ['kind']), 'q')}", ("cons", "jets"))
def features_int_rel_const_topo(spark, d):
    return node_sums(topo_jets(spark, d), "int_rel_const_topo", [*REL, "is_TopoTower"])


@query("features_int_rel_const_topo2", f"WITH {TWO}, {topo_axis('x')} {_sums_sql(_rel_sql('e / se', 'm', ['kind']), 'q')}", ("cons", "jets"))
def features_int_rel_const_topo2(spark, d):
    return node_sums(topo_jets(spark, d), "int_rel_const_topo2", [*REL, "is_TopoTower"])


@query("features_irc_safe_topo", f"WITH {TWO} {_sums_sql(['pt / jets_pt'], 'x')}", ("cons", "jets"))
def features_irc_safe_topo(spark, d):
    return node_sums(topo_jets(spark, d), "irc_safe_topo", ["PT|PTjet"], field="energy")


@query("features_int_const_track", _sums_sql(CONST_EXPRESSIONS, "lead"), ("lead", "jets"))
def features_int_const_track(spark, d):
    return node_sums(all_jets(jets(spark, d), tables.nested_constituents(spark, d, "Track")), "int_const_track", CONST)


@query("registered_feature_set", f"SELECT jet_id, {R('jets_pt / (1e0 + abs(jets_eta))')} AS central_pt, {R('jets_m / jets_pt')} AS mass_share FROM jets")
def registered_feature_set(spark, d):
    """A feature set of one's own, asked for by its name like the others."""

    def build(df, out, **_):
        central = F.col("jets_pt") / (F.lit(1.0) + F.abs("jets_eta"))
        return df.withColumn(out, F.struct(central.alias("central_pt"), (F.col("jets_m") / F.col("jets_pt")).alias("mass_share")))

    features.register("central", build)
    made = features.add_features(jets(spark, d), "central")
    return made.select("jet_id", r("features.central_pt").alias("central_pt"), r("features.mass_share").alias("mass_share"))


THREE = f"""{KINDS}, ok AS (SELECT jet_id FROM u GROUP BY jet_id),
    x AS ({LEADING})"""
IS = ["is_Constituent", "is_TopoTower", "is_Track"]


def three_collections(spark, d):
    rows = tables.constituents(spark, d)
    kinds = (("Constituent", "R"), ("TopoTower", "A"), ("Track", "N"))
    parts = [tables.nested_constituents(spark, d, kind, rows.where(F.col("l_returnflag") == flag)) for kind, flag in kinds]
    return all_jets(jets(spark, d), together(parts))


KINDS_SQL = _of_kind(0, 1, 2)


@query("features_const_topo_track", f"WITH {THREE} {_sums_sql([*CONST_EXPRESSIONS, *KINDS_SQL], 'x')}", ("cons", "jets"))
def features_const_topo_track(spark, d):
    return node_sums(three_collections(spark, d), "const_topo_track", [*CONST, *IS])


@query("features_int_const_topo_track", f"WITH {THREE} {_sums_sql([*CONST_EXPRESSIONS, *KINDS_SQL], 'x')}", ("cons", "jets"))
def features_int_const_topo_track(spark, d):
    return node_sums(three_collections(spark, d), "int_const_topo_track", [*CONST, *IS])


@query("features_int_rel_const_topo_track", f"WITH {THREE}, {topo_axis('x')} {_sums_sql(_rel_sql('e / apt', ln('m'), KINDS_SQL), 'q')}", ("cons", "jets"))
def features_int_rel_const_topo_track(spark, d):
    return node_sums(three_collections(spark, d), "int_rel_const_topo_track", [*REL, *IS])


ANGLES = ["eta - jets_eta", "phi - jets_phi", "sqrt((eta - jets_eta)*(eta - jets_eta) + (phi - jets_phi)*(phi - jets_phi))"]


@query("features_irc_safe_topo_track", f"WITH {THREE} {_sums_sql(ANGLES, 'x')}", ("cons", "jets"))
def features_irc_safe_topo_track(spark, d):
    return node_sums(three_collections(spark, d), "irc_safe_topo_track", ["deltaEta", "deltaPhi", "deltaR"], field="angular")


@query(
    "training_table",
    f"""SELECT jet_id, (CASE WHEN parton BETWEEN 1 AND 6 THEN 0 ELSE 1 END)::INT AS label, {R('weight')} AS weight, coalesce(n, 0)::INT AS n, {R('coalesce(s, 0e0)', 4)} AS pt
        FROM jets LEFT JOIN (SELECT jet_id, count(*)::INT AS n, sum({ln('pt')}) AS s FROM lead WHERE idx < 20 GROUP BY jet_id) USING (jet_id)
        WHERE jets_pt > 50000e0 AND jets_eta < 2.1e0 AND parton <> -1""",
    ("lead", "jets"),
)
def training_table_query(spark, d):
    out = training_table(
        tables.jets_nested(spark, d), "const", "parton", [(1, 2, 3, 4, 5, 6), 21], "jet_id", "weight",
        cut="(jets_pt>50_000) && (jets_eta<2.1)", unknown_labels=[-1], max_constituents=20,
    )
    node = F.col("features.node")
    return out.select(
        "jet_id", "label", r("weight").alias("weight"), F.size(node).alias("n"), r(total(node, lambda x: x["log_pT"]), 4).alias("pt")
    )


# --------------------------------------------------------------- augmentations
# Every draw is a digest of (seed, jet, step, element) that SQL states too, so the changed
# constituents themselves are compared, by position.


def augmented(spark, d, *steps):
    """Constituents of all jets after the steps: ``jet_id, idx, pt, eta, phi, m`` (idx: position in the array)."""
    df = augment(tables.nested_constituents(spark, d), "jet_id", steps)
    names = ("pt", "eta", "phi", "m")
    zipped = F.arrays_zip(*[F.col(f"jets_Constituent_{k}").alias(k) for k in names])
    rows = df.select("jet_id", F.posexplode(zipped).alias("idx", "x"))
    return rows.select("jet_id", "idx", *[r(F.col("x")[k], 3 if k == "pt" else 5).alias(k) for k in names])


CHANGED = f"{R('pt', 3)} AS pt, {R('eta', 5)} AS eta, {R('phi', 5)} AS phi, {R('m', 5)} AS m"
#: New momentum px, py, pz -> pt, eta, phi; the mass of the constituent stays.
MOVED = f"""SELECT jet_id, idx::INT AS idx, {R('sqrt(nx*nx + ny*ny)', 3)} AS pt, {R('atanh(nz / sqrt(nx*nx + ny*ny + nz*nz))', 5)} AS eta,
    {R('atan2(ny, nx)', 5)} AS phi, {R('m', 5)} AS m FROM moved"""


@query(
    "augment_rotation",
    f"""WITH {PLAIN}, s AS (SELECT jet_id, sum(px) AS sx, sum(py) AS sy, sum(pz) AS sz FROM p GROUP BY jet_id),
        a AS (SELECT jet_id, sx / l AS x, sy / l AS y, sz / l AS z, cos(t) AS c, sin(t) AS s FROM (SELECT *, sqrt(sx*sx + sy*sy + sz*sz) AS l,
            {draw(42, 'jet_id')} * (60e0 * pi() / 180e0) AS t FROM s)),
        moved AS (SELECT p.*, c*px + s*(y*pz - z*py) + x*k AS nx, c*py + s*(z*px - x*pz) + y*k AS ny, c*pz + s*(x*py - y*px) + z*k AS nz
            FROM (SELECT *, (x*px + y*py + z*pz) * (1e0 - c) AS k FROM p JOIN a USING (jet_id)) p) {MOVED}""",
    ("lead",),
)
def augment_rotation(spark, d):
    """Rotation about the summed momentum by one drawn angle."""
    return augmented(spark, d, ("rotation", {"max_angle": 60.0}))


@query(
    "augment_boost",
    f"""WITH {PLAIN}, g AS (SELECT jet_id, b * x / l AS x, b * y / l AS y, b * z / l AS z, b, 1e0 / sqrt(1e0 - b*b) AS g FROM
            (SELECT *, sqrt(x*x + y*y + z*z) AS l FROM (SELECT DISTINCT jet_id, {draw(42, 'jet_id', "'beta'")} * 0.3e0 AS b,
            {normal_draw(42, 'jet_id', "'x'")} AS x, {normal_draw(42, 'jet_id', "'y'")} AS y, {normal_draw(42, 'jet_id', "'z'")} AS z FROM lead))),
        moved AS (SELECT *, px + x*k AS nx, py + y*k AS ny, pz + z*k AS nz FROM
            (SELECT *, (g - 1e0) * (x*px + y*py + z*pz) / (b*b) - g * e AS k FROM p JOIN g USING (jet_id))) {MOVED}""",
    ("lead",),
)
def augment_boost(spark, d):
    """A boost along a drawn direction."""
    return augmented(spark, d, ("boost", {"max_beta": 0.3}))


@query(
    "augment_collinear_split",
    f"""WITH u AS (SELECT *, {draw(42, 'jet_id', 'idx', "'split'")} < 0.3e0 AS cut, 0.1e0 + {draw(42, 'jet_id', 'idx', "'share'")} * (0.9e0 - 0.1e0) AS f FROM lead),
        n AS (SELECT jet_id, CASE WHEN cut THEN pt * f ELSE pt END AS pt, eta, phi, m FROM u UNION ALL
            SELECT jet_id, pt * (1e0 - f), eta, phi, 0e0 FROM u WHERE cut)
        SELECT jet_id, (row_number() OVER (PARTITION BY jet_id ORDER BY pt DESC) - 1)::INT AS idx, {CHANGED} FROM n""",
    ("lead",),
)
def augment_collinear_split(spark, d):
    """Drawn constituents split in two along their direction, by a drawn share; sorted again."""
    return augmented(spark, d, ("collinear_split", {"amount": 0.3}))


def _dropped_sql(seed: int) -> str:
    return f"""u AS (SELECT *, {draw(seed, 'jet_id', 'idx')} > 1e0 - 1e0 / (1e0 + exp(idx - n * 0.6e0)) AS stays
            FROM (SELECT *, count(*) OVER (PARTITION BY jet_id) AS n FROM lead)),
        k AS (SELECT *, n < 3 OR NOT bool_or(stays) OVER (PARTITION BY jet_id) AS untouched FROM u)
        SELECT jet_id, (row_number() OVER (PARTITION BY jet_id ORDER BY idx) - 1)::INT AS idx, {CHANGED} FROM k WHERE stays OR untouched"""


@query("augment_drop_soft", f"WITH {_dropped_sql(42)}", ("lead",))
def augment_drop_soft(spark, d):
    """Soft constituents go with a rising chance; small jets, and those that would lose all, are not touched."""
    return augmented(spark, d, ("drop_soft", {"min_number": 3, "skew": 1.0, "center": 0.6}))


@query(
    "augment_soft_smear",
    f"""WITH n AS (SELECT * EXCLUDE (eta, phi), least(greatest(eta + 100e0 / pt * {normal_draw(42, 'jet_id', 'idx', "'eta'")}, -5e0), 5e0) AS eta,
            least(greatest(phi + 100e0 / pt * {normal_draw(42, 'jet_id', 'idx', "'phi'")}, -pi()), pi()) AS phi FROM lead)
        SELECT jet_id, idx::INT AS idx, {CHANGED} FROM n""",
    ("lead",),
)
def augment_soft_smear(spark, d):
    """Directions move by drawn amounts of a width of energy_scale / pt."""
    return augmented(spark, d, ("soft_smear", {"energy_scale": 100.0}))


def _pt_smeared_sql(share: str = "") -> str:
    smeared = f"least(greatest(pt * (1e0 + 0.1e0 * {normal_draw(42, 'jet_id', 'idx', repr('pt'))}), 1e-8), 1e8)"
    changed = f"CASE WHEN {share} THEN {smeared} ELSE pt END" if share else smeared
    return f"WITH n AS (SELECT * EXCLUDE (pt), {changed} AS pt FROM lead) SELECT jet_id, idx::INT AS idx, {CHANGED} FROM n"


@query("augment_pt_smear", _pt_smeared_sql(), ("lead",))
def augment_pt_smear(spark, d):
    """pt changes by drawn shares of it."""
    return augmented(spark, d, ("pt_smear", {"std_pt_frac": 0.1}))


@query("augment_chain", _pt_smeared_sql(f"{draw(42, 'jet_id', repr('apply'))} < 0.5e0"), ("lead",))
def augment_chain(spark, d):
    """A chain of a step that is drawn for half of the jets and one that is never drawn."""
    return augmented(spark, d, ("pt_smear", {"prob": 0.5}), ("drop_soft", {"prob": 0.0, "center": 0.0}))


# ----------------------------------------- averaged matrices, feature statistics


@query(
    "mean_pair_matrix",
    f"""WITH pr AS (SELECT label, a.idx AS i, b.idx AS j, weight, CASE WHEN a.idx = b.idx THEN 0e0 ELSE least(a.pt, b.pt) / (a.pt + b.pt) END AS z,
            CASE WHEN a.idx = b.idx THEN 0e0 ELSE {ln('sqrt((a.eta - b.eta)*(a.eta - b.eta) + (a.phi - b.phi)*(a.phi - b.phi))')} END AS delta
            FROM lead a JOIN lead b USING (jet_id) JOIN jets USING (jet_id) WHERE label IS NOT NULL AND a.idx < 10 AND b.idx < 10)
        SELECT label, i::INT AS i, j::INT AS j, {R('sum(z * weight) / sum(weight)', 5)} AS z, {R('sum(delta * weight) / sum(weight)', 4)} AS delta
        FROM pr GROUP BY label, i, j""",
    ("lead", "jets"),
)
def mean_pair_matrix(spark, d):
    df = tables.jets_nested(spark, d).where("label is not null")
    df = features.add_features(df, "int_const", max_constituents=10).select("label", "weight", F.col("features.edge").alias("edge"))
    out = pairs.mean_pair_matrix(df, "edge", ["z", "delta"], "weight", ["label"])
    return out.select("label", "i", "j", r("z", 5).alias("z"), r("delta", 4).alias("delta"))


@query(
    "mean_pair_matrix_range",
    f"""WITH pr AS (SELECT label, a.idx AS i, b.idx AS j, weight, CASE WHEN a.idx = b.idx THEN 0e0 ELSE least(a.pt, b.pt) / (a.pt + b.pt) END AS z
            FROM lead a JOIN lead b USING (jet_id) JOIN jets USING (jet_id) WHERE label IS NOT NULL AND a.idx < 10 AND b.idx < 10),
        m AS (SELECT sum(z * weight) / sum(weight) AS z FROM pr GROUP BY label, i, j)
        SELECT 'z' AS variable, {R('min(CASE WHEN z <> 0 THEN z END)', 5)} AS lo, {R('max(CASE WHEN z <> 0 THEN z END)', 5)} AS hi FROM m""",
    ("lead", "jets"),
)
def mean_pair_matrix_range(spark, d):
    df = tables.jets_nested(spark, d).where("label is not null")
    df = features.add_features(df, "int_const", max_constituents=10).select("label", "weight", F.col("features.edge").alias("edge"))
    means = pairs.mean_pair_matrix(df, "edge", ["z"], "weight", ["label"])
    return pairs.nonzero_range(means, ["z"]).select("variable", r("lo", 5).alias("lo"), r("hi", 5).alias("hi"))


@query(
    "mean_nonzero_matrix",
    f"""WITH pr AS (SELECT a.idx AS i, b.idx AS j, CASE WHEN a.idx = b.idx THEN 0e0 ELSE least(a.pt, b.pt) / (a.pt + b.pt) END AS z
            FROM lead a JOIN lead b USING (jet_id) WHERE a.idx < 6 AND b.idx < 6)
        SELECT i::INT AS i, j::INT AS j, {R('sum(z) / nullif(count(CASE WHEN z <> 0 THEN 1 END), 0)', 5)} AS mean_z FROM pr GROUP BY i, j""",
    ("lead",),
)
def mean_nonzero_matrix(spark, d):
    df = features.add_features(tables.jets_nested(spark, d), "int_const", max_constituents=6)
    padded = nested.pad_records(df.select(F.col("features.edge").alias("edge")), 6, 0.0, edge="edge", mask=None)
    out = pairs.mean_nonzero_matrix(padded, "edge", "z")
    return out.select("i", "j", r("mean_z", 5).alias("mean_z"))


NODE_LONG = "v AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS feature, {x} AS x FROM lead JOIN jets USING (jet_id)" for name, x in zip(CONST, CONST_EXPRESSIONS)
) + ")"


@query(
    "feature_moments",
    f"WITH {NODE_LONG} SELECT feature, {R('avg(x)', 7)} AS mean, {R('var_pop(x)', 4)} AS variance FROM v GROUP BY feature",
    ("lead", "jets"),
)
def feature_moments(spark, d):
    df = features.add_features(tables.jets_nested(spark, d), "const").select(F.col("features.node").alias("node"))
    out = rank.feature_moments(df, "node")
    return out.select("feature", r("mean", 7).alias("mean"), r("variance", 4).alias("variance"))


@query(
    "feature_ranges",
    f"WITH {NODE_LONG} SELECT feature, {R('min(x)', 5)} AS lo, {R('max(x)', 5)} AS hi FROM v GROUP BY feature",
    ("lead", "jets"),
)
def feature_ranges(spark, d):
    df = features.add_features(tables.jets_nested(spark, d), "const").select(F.col("features.node").alias("node"))
    out = rank.feature_ranges(df, "node")
    return out.select("feature", r("lo", 5).alias("lo"), r("hi", 5).alias("hi"))


@query(
    "min_max_scaled_features",
    f"""WITH t AS (SELECT min(jets_pt) AS lo, max(jets_pt) AS hi, min(jets_eta) AS elo, max(jets_eta) AS ehi FROM jets)
        SELECT jet_id, {R('(jets_pt - lo) / (hi - lo)')} AS pt, {R('(jets_eta - elo) / (ehi - elo)')} AS eta FROM jets, t""",
)
def min_max_scaled_features(spark, d):
    df = jets(spark, d).select("jet_id", F.struct("jets_pt", "jets_eta").alias("f"))
    out = rank.min_max_scale(df, "f", rank.feature_ranges(df, "f"), "s")
    return out.select("jet_id", r("s.jets_pt").alias("pt"), r("s.jets_eta").alias("eta"))


@query(
    "standardised_features",
    f"""WITH t AS (SELECT avg(jets_pt) AS m, stddev_pop(jets_pt) AS s FROM jets)
        SELECT jet_id, {R('(jets_pt - m) / s')} AS pt FROM jets, t""",
)
def standardised_features(spark, d):
    df = jets(spark, d).select("jet_id", F.struct("jets_pt").alias("f"))
    out = rank.standard_scale(df, "f", rank.feature_moments(df, "f"), "s")
    return out.select("jet_id", r("s.jets_pt").alias("pt"))


CORR = ["jets_pt", "jets_eta", "score", "weight"]


@query(
    "correlation_matrix",
    " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {R(f'corr({a}, {b})', 5)} AS corr FROM jets" for a in CORR for b in CORR),
)
def correlation_matrix(spark, d):
    return rank.correlation_matrix(jets(spark, d), CORR).select("a", "b", r("corr", 5).alias("corr"))


def _anova_sql(c: str) -> str:
    return f"""SELECT '{c}' AS variable, ((SELECT sum(n * (m - g) * (m - g)) FROM (SELECT count(*) AS n, avg({c}) AS m,
            (SELECT avg({c}) FROM k) AS g FROM k GROUP BY label)) / (count(DISTINCT label) - 1)) /
            ((SELECT sum(v) FROM (SELECT var_pop({c}) * count(*) AS v FROM k GROUP BY label)) / (count(*) - count(DISTINCT label))) AS score FROM k"""


@query(
    "anova_feature_ranking",
    "WITH k AS (SELECT * FROM jets WHERE label IS NOT NULL), s AS ("
    + " UNION ALL ".join(_anova_sql(c) for c in ("score", "weight", "jets_pt"))
    + f") SELECT variable, {R('score', 4)} AS score FROM s ORDER BY s.score DESC LIMIT 2",
)
def anova_feature_ranking(spark, d):
    scores = rank.anova_f(jets(spark, d), ["score", "weight", "jets_pt"], "label")
    return rank.best_features(scores, 2).select("variable", r("score", 4).alias("score"))


def _mi_sql(b) -> str:
    return f"""SELECT '{b.variable}' AS variable, {R('sum(n / a * ln(n * a / (nx * ny)))', 6)} AS score FROM (SELECT n::DOUBLE AS n,
        sum(n) OVER () ::DOUBLE AS a, sum(n) OVER (PARTITION BY bin)::DOUBLE AS nx, sum(n) OVER (PARTITION BY label)::DOUBLE AS ny FROM
        (SELECT {case_bins(b.variable, b.edges)} AS bin, label, count(*) AS n FROM jets WHERE label IS NOT NULL GROUP BY 1, 2))"""


@query("mutual_information_ranking", " UNION ALL ".join(_mi_sql(b) for b in (PT, ETA)))
def mutual_information_ranking(spark, d):
    out = rank.mutual_information(jets(spark, d), [PT, ETA], "label")
    return out.select("variable", r("score", 6).alias("score"))


#: Whole numbers, so that SQL can give a window the width of a radius; eta and the ids repeat a lot.
NEIGHBOUR_SQL = {
    "pt_cents": "round(jets_pt * 100e0)",
    "eta_hundredths": "round(jets_eta * 100e0)",
    "score_steps": "((jet_id * 7919) % 10007 + 2500 * label)::DOUBLE",
}


def _psi(x: str) -> str:
    up = f"({x} + 6e0)"
    steps = "".join(f" - 1e0 / ({x} + {i}e0)" for i in range(6))
    return f"(ln({up}) - 0.5e0 / {up} - 1e0 / (12e0 * pow({up}, 2)) + 1e0 / (120e0 * pow({up}, 4)) - 1e0 / (252e0 * pow({up}, 6)){steps})"


def _neighbour_sql(name: str) -> str:
    places = ", ".join(f"abs(x - {f}(x, {i}) OVER c)" for f in ("lag", "lead") for i in (1, 2, 3))
    return f"""SELECT '{name}' AS variable, {R(f"greatest(0e0, {_psi('count(*)')} + avg({_psi('3e0')} - {_psi('size')} - {_psi('m')}))", 6)} AS score
        FROM (SELECT size, count(*) OVER (ORDER BY x RANGE BETWEEN w PRECEDING AND w FOLLOWING)::DOUBLE AS m
            FROM (SELECT x, size::DOUBLE AS size, greatest(radius - 1e0, 0e0) AS w FROM (SELECT x, count(*) OVER (PARTITION BY label) AS size,
                list_sort(list_filter([{places}], lambda z: z IS NOT NULL))[3] AS radius
                FROM (SELECT label, {NEIGHBOUR_SQL[name]} AS x FROM jets WHERE label IS NOT NULL) WINDOW c AS (PARTITION BY label ORDER BY x))))"""


@query("neighbour_information_ranking", " UNION ALL ".join(map(_neighbour_sql, NEIGHBOUR_SQL)))
def neighbour_information_ranking(spark, d):
    """Mutual information with the class from the three nearest neighbours."""
    df = jets(spark, d).select(
        "label",
        F.round(F.col("jets_pt") * 100.0).alias("pt_cents"),
        F.round(F.col("jets_eta") * 100.0).alias("eta_hundredths"),
        ((F.col("jet_id") * 7919) % 10007 + F.col("label") * 2500).cast("double").alias("score_steps"),
    )
    out = information.neighbour_information(df, list(NEIGHBOUR_SQL), "label")
    return out.select("variable", r("score", 6).alias("score"))


def _noise_sql(f: str) -> str:
    noise = f"((SELECT avg({f}) FROM jets) - half_{f} + {draw(42, 'jet_id', repr(f))} * half_{f} * 2e0)"
    used = {"score": "score", "jets_eta": "jets_eta"} | {f: noise}
    return f"""SELECT '{f}' AS variable, {R('a')} AS accuracy, {R('w')} AS noisy_accuracy, {R('a - w')} AS importance FROM
        (SELECT avg((score + 0.02e0 * jets_eta > 0.5e0)::INT = label)::DOUBLE AS a,
            avg(({used['score']} + 0.02e0 * {used['jets_eta']} > 0.5e0)::INT = label)::DOUBLE AS w
        FROM jets, (SELECT sqrt(3e0) * stddev_pop({f}) AS half_{f} FROM jets) WHERE label IS NOT NULL)""".replace(" = label)", " = label)::INT)").replace("avg((", "avg(((")


@query("noise_importance", " UNION ALL ".join(_noise_sql(f) for f in ("score", "jets_eta")))
def noise_importance(spark, d):
    """Accuracy lost when noise replaces a feature, for one that matters much and one that matters little."""
    scorer = lambda c: c["score"] + 0.02 * c["jets_eta"]
    out = rank.noise_importance(jets(spark, d), ["score", "jets_eta"], scorer, "label", "jet_id")
    return out.select("variable", *[r(c).alias(c) for c in ("accuracy", "noisy_accuracy", "importance")])


# --------------------------------------------------------------------- scoring


@query("score_in_batches", f"SELECT jet_id, {R('1e0 / (1e0 + exp(-(jets_pt / 250000e0 - 1e0)))')} AS score FROM jets")
def score_in_batches(spark, d):
    def scorer(batch):
        import numpy as np

        return 1.0 / (1.0 + np.exp(-(batch["jets_pt"] / 250000.0 - 1.0)))

    df = jets(spark, d).select("jet_id", "jets_pt")
    return scoring.score_in_batches(df, scorer).select("jet_id", r("score").alias("score"))


@query("score_many_models", f"SELECT jet_id, {R('jets_pt / 500000e0', 9)} AS fc_score, {R('abs(jets_eta) / 5e0')} AS bdt_score FROM jets")
def score_many_models(spark, d):
    models = {"fc": lambda df: df.jets_pt / 500000.0, "bdt": lambda df: F.abs(df.jets_eta) / 5.0}
    out = scoring.score_models(jets(spark, d), models)
    return out.select("jet_id", r("fc_score", 9).alias("fc_score"), r("bdt_score").alias("bdt_score"))


@query("cached_scores", f"SELECT jet_id, {R('score')} AS score FROM jets")
def cached_scores(spark, d):
    from sparkjets.sources import io

    df = jets(spark, d).select("jet_id", "score")
    folder = io.shared_folder(spark)
    scoring.cached_scores(df, lambda x: x, folder, "model-a")
    again = scoring.cached_scores(df, lambda x: x.where("false"), folder, "model-a")  # read back, not computed
    return again.select("jet_id", r("score").alias("score"))


#: A learner sees the event weight, which tells a part of the classes apart, and two numbers that tell nothing.
LEARN_FROM = ["weight", "jets_pt", "jets_eta"]
#: The best a learner can do on the rows held out: rank them by the share of the class among the training rows of their weight.
LEARNED = f"""WITH k AS (SELECT weight, label, {draw(42, 'jet_id')} <= 0.7e0 AS train FROM jets WHERE label IS NOT NULL),
    s AS (SELECT weight, avg(label) AS score FROM k WHERE train GROUP BY weight),
    g AS (SELECT score, sum(label)::DOUBLE AS p, sum(1 - label)::DOUBLE AS n FROM k JOIN s USING (weight) WHERE NOT train GROUP BY score),
    c AS (SELECT p, n, sum(n) OVER (ORDER BY score) AS below FROM g)
    SELECT sum(p + n)::BIGINT AS held_out, floor(10 * sum(p * (below - n / 2)) / (sum(p) * sum(n)))::BIGINT AS auc_tenths FROM c"""


def trainable(spark, d):
    """Rows to learn from and rows held out, by a draw."""
    df = jets(spark, d).where("label is not null").select("jet_id", *LEARN_FROM, F.col("label").cast("double").alias("label"))
    parts = split.split_random(df, {"train": 0.7, "test": 0.3}, "jet_id")
    return [parts.where(F.col("split") == name).drop("split") for name in ("train", "test")]


def _judged(scored, score):
    exact = scored.withColumn("label", F.col("label").cast("int"))
    out = metrics.all_metrics(exact, score, "label")
    return out.select(F.col("num_events").cast("long").alias("held_out"), F.floor(F.col("auc") * 10).cast("long").alias("auc_tenths"))


@query("boosted_trees", LEARNED)
def boosted_trees(spark, d):
    train, test = trainable(spark, d)
    model = scoring.train_boosted_trees(train, LEARN_FROM, "label", trees=5, depth=3)
    return _judged(scoring.apply_model(model, test, LEARN_FROM, "bdt"), "bdt")


@query("dense_classifier", LEARNED)
def dense_classifier(spark, d):
    train, test = trainable(spark, d)
    model = scoring.train_dense(train, LEARN_FROM, "label", hidden=(8,), epochs=60)
    return _judged(scoring.apply_model(model, test, [], "fc"), "fc")
