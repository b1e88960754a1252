"""Feature sets: what a model sees of a jet.

A feature set adds one struct column. Per-constituent features are an
``array<struct>`` (``node``), per-pair features an ``array<array<struct>>``
(``edge``), so every value is computed in one walk over the array and no row is
multiplied: the pair matrices of a jet never leave its row, and a feature set
needs no shuffle.

New sets are added with :func:`register`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkjets.functions import pair_kernel, vectors
from sparkjets.functions.arrays import let, pad, pad_mask, total, zip_columns
from sparkjets.functions.constituents import collection_columns, ordered, type_fields
from sparkjets.functions.numeric import hypot, log_clip, ratio

Builder = Callable[..., DataFrame]
REGISTRY: dict[str, Builder] = {}


def register(name: str, builder: Builder) -> None:
    """Add a feature set: ``builder(df, out, **options) -> DataFrame`` with column ``out``."""
    REGISTRY[name] = builder


def add_features(df: DataFrame, name: str, out: str = "features", **options) -> DataFrame:
    if name not in REGISTRY:
        raise ValueError(f"unknown feature set {name!r}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name](df, out, **options)


# --------------------------------------------------------------- whole-jet sets

# The columns of the high-level sets. The second list of a set
# holds array columns of which the first entry is used.
FULL_HIGHLEVEL = [
    "jets_ActiveArea4vec_eta",
    "jets_ActiveArea4vec_m",
    "jets_ActiveArea4vec_phi",
    "jets_ActiveArea4vec_pt",
    "jets_DetectorEta",
    "jets_FracSamplingMax",
    "jets_FracSamplingMaxIndex",
    "jets_GhostMuonSegmentCount",
    "jets_JVFCorr",
    "jets_JetConstitScaleMomentum_eta",
    "jets_JetConstitScaleMomentum_m",
    "jets_JetConstitScaleMomentum_phi",
    "jets_JetConstitScaleMomentum_pt",
    "jets_JvtRpt",
    "jets_fJVT",
    "jets_passFJVT",
    "jets_passJVT",
    "jets_Timing",
    "jets_Jvt",
    "jets_EMFrac",
    "jets_Width",
    "jets_chf",
    "jets_eta",
    "jets_m",
    "jets_phi",
    "jets_pt",
    "corrected_averageInteractionsPerCrossing",
]
FULL_HIGHLEVEL_FIRST = [
    "jets_ChargedPFOWidthPt1000",
    "jets_TrackWidthPt1000",
    "jets_NumChargedPFOPt1000",
    "jets_SumPtChargedPFOPt500",
    "jets_NumChargedPFOPt500",
]
HIGHLEVEL = [
    "jets_EMFrac",
    "jets_chf",
    "jets_eta",
    "jets_m",
    "jets_phi",
    "jets_pt",
    "jets_Width",
]
HIGHLEVEL_FIRST = [
    "jets_NumChargedPFOPt500",
]
JETCLASS_HIGHLEVEL = [
    "jet_tau4",
    "jet_eta",
    "jet_nparticles",
    "jet_tau3",
    "jet_sdmass",
    "jet_pt",
    "jet_tau2",
    "jet_phi",
    "jet_tau1",
    "jet_energy",
]


def _whole_jet(columns: Sequence[str], first: Sequence[str] = (), counted: bool = False) -> Builder:
    def build(df: DataFrame, out: str, variables=None, const_name: str = "Constituent", **_) -> DataFrame:
        plain = list(columns) if variables is None else list(variables)
        if counted and variables is None:
            plain.append(f"jets_{const_name}_n")
        fields = [F.col(c).cast("double").alias(c) for c in plain]
        fields += [F.get(F.col(c), F.lit(0)).cast("double").alias(c) for c in first]
        return df.withColumn(out, F.struct(*fields))

    return build


def jet_width(c: Column, jet_eta: Column, jet_phi: Column) -> Column:
    """pt-weighted mean distance of the constituents from the jet axis."""
    weighted = total(c, lambda x: x["pt"] * hypot(jet_eta - x["eta"], jet_phi - x["phi"]))
    return ratio(weighted, total(c, lambda x: x["pt"]))


def energy_correlation(c: Column, beta: float = 0.2) -> Column:
    """Sum over ordered pairs of pt_i pt_j dR_ij^beta, over the squared pt sum.

    Each unordered pair is visited once: element i meets the elements after it.
    """

    def with_later(x: Column, i: Column) -> Column:
        later = F.slice(c, i + 2, F.size(c))
        return total(later, lambda y: x["pt"] * y["pt"] * F.pow(hypot(x["eta"] - y["eta"], x["phi"] - y["phi"]), beta))

    pairs = total(F.transform(c, with_later))
    pt_sum = total(c, lambda x: x["pt"])
    return ratio(pairs * 2.0, pt_sum * pt_sum)


def _crafted(with_eta: bool) -> Builder:
    def build(df: DataFrame, out: str, const_name: str = "Constituent", **_) -> DataFrame:
        counter = f"jets_{const_name}_n"
        work = df.withColumn("_c", zip_columns(collection_columns(const_name)))
        count = F.col(counter) if counter in df.columns else F.size("_c")
        fields = [F.col("jets_pt").alias("pt_jet")]
        if with_eta:
            fields.append(F.col("jets_eta").alias("eta_jet"))
        fields += [
            count.cast("double").alias("N_PFO"),
            jet_width(F.col("_c"), F.col("jets_eta"), F.col("jets_phi")).alias("W_PFO_jet"),
            energy_correlation(F.col("_c")).alias("C1_PFO_jet"),
        ]
        return work.withColumn(out, F.struct(*fields)).drop("_c")

    return build


# ------------------------------------------------------------ constituent sets


def _measured(c: Column, jet: dict[str, Column]) -> Column:
    """Per constituent: pt, transverse energy, their jet fractions, offsets from the jet axis."""
    jet_e = hypot(jet["pt"], jet["m"])

    def one(x: Column) -> Column:
        e = hypot(x["pt"], x["m"])
        return F.struct(
            x["pt"].alias("pt"),
            ratio(x["pt"], jet["pt"]).alias("pt_frac"),
            e.alias("e"),
            ratio(e, jet_e).alias("e_frac"),
            (x["eta"] - jet["eta"]).alias("deta"),
            (x["phi"] - jet["phi"]).alias("dphi"),
            x["m"].alias("m"),
            x["kind"].alias("kind"),
        )

    return F.transform(c, one)


def _absolute_node(c: Column, jet: dict[str, Column], kinds: Sequence[str]) -> Column:
    return F.transform(
        _measured(c, jet),
        lambda r: F.struct(
            log_clip(r["pt"]).alias("log_pT"),
            log_clip(r["pt_frac"]).alias("log_PT|PTjet"),
            log_clip(r["e"]).alias("log_E"),
            log_clip(r["e_frac"]).alias("log_E|Ejet"),
            r["deta"].alias("deltaEta"),
            r["dphi"].alias("deltaPhi"),
            hypot(r["deta"], r["dphi"]).alias("deltaR"),
            log_clip(r["m"]).alias("m"),
            *type_fields(r, kinds),
        ),
    )


def _momenta(c: Column) -> Column:
    """Constituents with their Cartesian momenta added."""

    def one(x: Column) -> Column:
        return let(
            vectors.cartesian_struct(x),
            lambda p: F.struct(
                *[x[f].alias(f) for f in ("m", "pt", "eta", "phi", "kind")],
                *[p[k].alias(k) for k in ("E", "px", "py", "pz")],
            ),
        )

    return F.transform(c, one)


def _summed_axis(c: Column, clipped: bool) -> Column:
    """Jet axis re-summed from constituents that carry momenta."""
    sums = F.aggregate(
        c,
        F.struct(*[F.lit(0.0).alias(n) for n in ("px", "py", "pz", "E")]),
        lambda acc, x: F.struct(
            (acc["px"] + x["px"]).alias("px"),
            (acc["py"] + x["py"]).alias("py"),
            (acc["pz"] + x["pz"]).alias("pz"),
            (acc["E"] + F.least(F.greatest(x["E"], F.lit(1e-10)), F.lit(1e10))).alias("E"),
        ),
    )

    def bounded(x: Column) -> Column:
        return F.least(F.greatest(x, F.lit(1e-10)), F.lit(1e10))

    def finish(s: Column) -> Column:
        pt = hypot(s["px"], s["py"])
        return let(
            F.struct((bounded(pt) if clipped else pt).alias("pt"), s.alias("s")),
            lambda t: F.struct(
                t["pt"].alias("pt"),
                F.asinh(ratio(t["s"]["pz"], t["pt"])).alias("eta"),
                F.atan2(t["s"]["py"], t["s"]["px"]).alias("phi"),
                bounded(t["s"]["E"]).alias("E"),
            ),
        )

    return let(sums, finish)


def _scaled(c: Column, axis: Column) -> Column:
    """Momenta in units of the axis pt, angles relative to the axis."""
    return F.transform(
        c,
        lambda x: F.struct(
            x["m"].alias("m"),
            ratio(x["pt"], axis["pt"]).alias("pt"),
            (x["eta"] - axis["eta"]).alias("eta"),
            (x["phi"] - axis["phi"]).alias("phi"),
            x["kind"].alias("kind"),
            ratio(x["E"], axis["pt"]).alias("E"),
            ratio(x["px"], axis["pt"]).alias("px"),
            ratio(x["py"], axis["pt"]).alias("py"),
            ratio(x["pz"], axis["pt"]).alias("pz"),
            ratio(x["E"], axis["E"]).alias("E_share"),
        ),
    )


def pair_cell(a: Column, b: Column, angle: str = "eta", wrap: bool = False, log_z: bool = False) -> Column:
    """delta, k_t, z and m2 of two constituents that carry momenta."""

    def raw(dphi: Column) -> Column:
        energy, px, py, pz = (a[k] + b[k] for k in ("E", "px", "py", "pz"))
        return F.struct(
            hypot(a[angle] - b[angle], dphi).alias("dr"),
            F.least(a["pt"], b["pt"]).alias("pt_min"),
            (a["pt"] + b["pt"]).alias("pt_sum"),
            (energy * energy - px * px - py * py - pz * pz).alias("m2"),
        )

    def final(p: Column) -> Column:
        z = ratio(p["pt_min"], p["pt_sum"])
        return F.struct(
            log_clip(p["dr"]).alias("delta"),
            log_clip(p["pt_min"] * p["dr"]).alias("k_t"),
            (log_clip(z) if log_z else z).alias("z"),
            log_clip(p["m2"]).alias("m2"),
        )

    if wrap:
        return let(let(vectors.delta_phi(a["phi"], b["phi"]), raw), final)
    return let(raw(a["phi"] - b["phi"]), final)


def pair_matrix(c: Column, angle: str = "eta", wrap: bool = False, log_z: bool = False) -> Column:
    """``[N, N]`` matrix of delta, k_t, z and m2 over the constituents of one jet, zero on the diagonal."""
    zero = F.struct(*[F.lit(0.0).alias(n) for n in ("delta", "k_t", "z", "m2")])
    return F.transform(
        c,
        lambda a, i: F.transform(c, lambda b, j: F.when(i == j, zero).otherwise(pair_cell(a, b, angle, wrap, log_z))),
    )


def _pairs(c: Column, engine: str, **options) -> Column:
    """Pair matrices from the batch kernel, or from built-in expressions with ``engine="builtin"``.

    Both give the same numbers; the kernel is several times faster and its lead
    grows with the number of constituents.
    """
    if engine == "builtin":
        return pair_matrix(c, **options)
    if engine == "arrow":
        return pair_kernel.pair_matrix(c, **options)
    raise ValueError(f"unknown engine {engine!r}")


def _jet_columns(jet: str = "jets") -> dict[str, Column]:
    return {k: F.col(f"{jet}_{k}").cast("double") for k in ("m", "pt", "eta", "phi")}


def _constituent_set(node, edge=False, kinds=("{const}",), momenta=False, axis=None) -> Builder:
    """Builder over pt-sorted constituents; the staged columns keep shared work from being repeated."""

    def build(
        df, out, max_constituents: int | None = None, const_name: str = "Constituent", engine: str = "arrow", **_
    ) -> DataFrame:
        names = [k.format(const=const_name) for k in kinds]
        work = df.withColumn("_c", ordered(names, max_constituents))
        if momenta:
            work = work.withColumn("_c", _momenta(F.col("_c")))
        if axis is not None:
            work = work.withColumn("_axis", _summed_axis(F.col("_c"), clipped=axis == "clipped"))
            work = work.withColumn("_c", _scaled(F.col("_c"), F.col("_axis")))
        parts = node(F.col("_c"), names, max_constituents)
        if edge:
            parts = [*parts, _pairs(F.col("_c"), engine).alias("edge")]
        return work.withColumn(out, F.struct(*parts)).drop("_c", "_axis")

    return build


def _const_node(c, kinds, _max):
    return [_absolute_node(c, _jet_columns(), kinds).alias("node")]


def _gnn_node(c, kinds, max_constituents):
    if max_constituents is None:
        raise ValueError("max_constituents must be set for the gnn set")
    node = _absolute_node(c, _jet_columns(), kinds)
    names = ["log_pT", "log_PT|PTjet", "log_E", "log_E|Ejet", "deltaEta", "deltaPhi", "deltaR", "m"]
    names += [] if len(kinds) == 1 else ([f"is_{kinds[1]}"] if len(kinds) == 2 else [f"is_{k}" for k in kinds])
    blank = F.struct(*[F.lit(0.0).alias(n) for n in names])
    padded = pad(node, max_constituents, blank)
    points = F.transform(padded, lambda r: F.struct(r["deltaEta"].alias("deltaEta"), r["deltaPhi"].alias("deltaPhi")))
    mask = F.transform(pad_mask(c, max_constituents), lambda keep: keep.cast("double"))
    return [points.alias("points"), padded.alias("node"), mask.alias("mask")]


def _irc_node(c, kinds, _max):
    measured = _measured(c, _jet_columns())
    angular = F.transform(
        measured,
        lambda r: F.struct(
            r["deta"].alias("deltaEta"), r["dphi"].alias("deltaPhi"), hypot(r["deta"], r["dphi"]).alias("deltaR")
        ),
    )
    energy = F.transform(measured, lambda r: F.struct(r["pt_frac"].alias("PT|PTjet")))
    return [angular.alias("angular"), energy.alias("energy")]


def _rel_node(c, kinds, _max):
    # Scaled input; this set divides by the axis pt and subtracts the axis a second time.
    axis = F.col("_axis")
    jet_e = hypot(axis["pt"], F.col("jets_m").cast("double"))
    raw = F.transform(
        c,
        lambda x: F.struct(
            ratio(x["pt"], axis["pt"]).alias("pt_frac"),
            ratio(x["E"], jet_e).alias("e_frac"),
            (x["eta"] - axis["eta"]).alias("deta"),
            (x["phi"] - axis["phi"]).alias("dphi"),
            x["m"].alias("m"),
            x["kind"].alias("kind"),
        ),
    )
    node = F.transform(
        raw,
        lambda r: F.struct(
            log_clip(r["pt_frac"]).alias("log_PT|PTjet"),
            log_clip(r["e_frac"]).alias("log_E|Ejet"),
            r["deta"].alias("deltaEta"),
            r["dphi"].alias("deltaPhi"),
            hypot(r["deta"], r["dphi"]).alias("deltaR"),
            log_clip(r["m"]).alias("m"),
            *type_fields(r, kinds),
        ),
    )
    return [node.alias("node")]


def _int_rel_node(energy: str, log_mass: bool):
    def node(c, kinds, _max):
        return [
            F.transform(
                c,
                lambda x: F.struct(
                    log_clip(x["pt"]).alias("log_PT|PTjet"),
                    log_clip(x[energy]).alias("log_E|Ejet"),
                    x["eta"].alias("deltaEta"),
                    x["phi"].alias("deltaPhi"),
                    hypot(x["eta"], x["phi"]).alias("deltaR"),
                    (log_clip(x["m"]) if log_mass else x["m"]).alias("m"),
                    *type_fields(x, kinds),
                ),
            ).alias("node")
        ]

    return node


# -------------------------------------------------------------- JetClass sets

# Particle-type columns of the JetClass layout and their feature names.
JETCLASS_PID = {
    "charge": "part_charge",
    "is_electron": "part_isElectron",
    "is_muon": "part_isMuon",
    "is_photon": "part_isPhoton",
    "is_neutral_hadron": "part_isNeutralHadron",
    "is_charged_hadron": "part_isChargedHadron",
}


def _jetclass_staged(df: DataFrame) -> DataFrame:
    inputs = {"px": "part_px", "py": "part_py", "pz": "part_pz", "E": "part_energy", **JETCLASS_PID}
    inputs |= {"d0": "part_d0val", "d0_err": "part_d0err", "dz": "part_dzval", "dz_err": "part_dzerr"}
    zipped = F.arrays_zip(*[F.col(c) for c in inputs.values()])

    def one(s: Column) -> Column:
        p = [s[inputs[k]].cast("double") for k in ("E", "px", "py", "pz")]
        v = vectors.cylindrical_rapidity(*p)
        return F.struct(
            *[s[c].cast("double").alias(f) for f, c in inputs.items()],
            *[v[k].alias(k) for k in ("pt", "y", "phi")],
            vectors.cylindrical(*p)["eta"].alias("eta"),
        )

    return df.withColumn("_c", F.transform(zipped, one))


def _jetclass_node(c: Column) -> Column:
    jet = {k: F.col(f"jet_{k}").cast("double") for k in ("energy", "pt", "eta", "phi")}
    raw = F.transform(
        c,
        lambda x: F.struct(
            x.alias("x"),
            ratio(x["pt"], jet["pt"]).alias("pt_frac"),
            ratio(x["E"], jet["energy"]).alias("e_frac"),
            (x["eta"] - jet["eta"]).alias("deta"),
            vectors.delta_phi(x["phi"], jet["phi"]).alias("dphi"),
        ),
    )
    return F.transform(
        raw,
        lambda r: F.struct(
            log_clip(r["x"]["pt"]).alias("log_pT"),
            log_clip(r["pt_frac"]).alias("log_PT|PTjet"),
            log_clip(r["x"]["E"]).alias("log_E"),
            log_clip(r["e_frac"]).alias("log_E|Ejet"),
            r["deta"].alias("deltaEta"),
            r["dphi"].alias("deltaPhi"),
            hypot(r["deta"], r["dphi"]).alias("deltaR"),
            *[r["x"][f].alias(f) for f in JETCLASS_PID],
            r["x"]["d0_err"].alias("d0_err"),
            r["x"]["dz_err"].alias("dz_err"),
            F.tanh(r["x"]["d0"]).alias("tanh_d0"),
            F.tanh(r["x"]["dz"]).alias("tanh_dz"),
        ),
    )


def _jetclass(edge: bool = False, points: bool = False) -> Builder:
    def build(df: DataFrame, out: str, engine: str = "arrow", max_constituents: int | None = None, **_) -> DataFrame:
        work = _jetclass_staged(df)
        if max_constituents is not None:
            work = work.withColumn("_c", F.slice("_c", 1, max_constituents))
        work = work.withColumn("_node", _jetclass_node(F.col("_c")))
        parts = [F.col("_node").alias("node")]
        if edge:
            parts.append(_pairs(F.col("_c"), engine, angle="y", wrap=True, log_z=True).alias("edge"))
        if points:
            parts.append(
                F.transform(
                    "_node", lambda r: F.struct(r["deltaEta"].alias("deltaEta"), r["deltaPhi"].alias("deltaPhi"))
                ).alias("points")
            )
        return work.withColumn(out, F.struct(*parts)).drop("_c", "_node")

    return build


# -------------------------------------------------------------------- registry

_TOPO = ("{const}", "TopoTower")
_TOPO_TRACK = ("{const}", "TopoTower", "Track")
_int_rel = {"node": _int_rel_node("E", True), "edge": True, "momenta": True, "axis": "clipped"}
_int_rel2 = {"node": _int_rel_node("E_share", False), "edge": True, "momenta": True, "axis": "clipped"}
_int_const = {"node": _const_node, "edge": True, "momenta": True}
_rel = {"node": _rel_node, "momenta": True, "axis": "plain"}

for _name, _builder in {
    "full_highlevel": _whole_jet(FULL_HIGHLEVEL, FULL_HIGHLEVEL_FIRST, counted=True),
    "highlevel": _whole_jet(HIGHLEVEL, HIGHLEVEL_FIRST),
    "highlevel_no_eta": _whole_jet([c for c in HIGHLEVEL if c != "jets_eta"], HIGHLEVEL_FIRST),
    "crafted_highlevel": _crafted(with_eta=True),
    "crafted_highlevel_no_eta": _crafted(with_eta=False),
    "const": _constituent_set(_const_node),
    "rel_const": _constituent_set(**_rel),
    "gnn": _constituent_set(_gnn_node),
    "int_const": _constituent_set(**_int_const),
    "int_rel_const": _constituent_set(**_int_rel),
    "int_rel_const2": _constituent_set(**_int_rel2),
    "irc_safe": _constituent_set(_irc_node),
    "int_const_track": _constituent_set(**_int_const, kinds=("Track",)),
    "const_topo": _constituent_set(_const_node, kinds=_TOPO),
    "rel_const_topo": _constituent_set(**_rel, kinds=_TOPO),
    "int_const_topo": _constituent_set(**_int_const, kinds=_TOPO),
    "int_rel_const_topo": _constituent_set(**_int_rel, kinds=_TOPO),
    "int_rel_const_topo2": _constituent_set(**_int_rel2, kinds=_TOPO),
    "irc_safe_topo": _constituent_set(_irc_node, kinds=_TOPO),
    "const_topo_track": _constituent_set(_const_node, kinds=_TOPO_TRACK),
    "int_const_topo_track": _constituent_set(**_int_const, kinds=_TOPO_TRACK),
    "int_rel_const_topo_track": _constituent_set(**_int_rel, kinds=_TOPO_TRACK),
    "irc_safe_topo_track": _constituent_set(_irc_node, kinds=_TOPO_TRACK),
    "jet_class": _jetclass(edge=True),
    "jet_class_non_int": _jetclass(),
    "jet_class_highlevel": _whole_jet(JETCLASS_HIGHLEVEL),
    "jet_class_pnet": _jetclass(points=True),
}.items():
    register(_name, _builder)
