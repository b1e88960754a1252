import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkjets.functions import features, pair_kernel
from sparkjets.functions.augment import AUGMENTATIONS, augment
from sparkjets.operators import pairs

# The names of the feature sets.
NAMES = """full_highlevel highlevel highlevel_no_eta crafted_highlevel crafted_highlevel_no_eta const rel_const gnn
int_const int_rel_const int_rel_const2 irc_safe int_const_track const_topo rel_const_topo int_const_topo
int_rel_const_topo int_rel_const_topo2 irc_safe_topo const_topo_track int_const_topo_track int_rel_const_topo_track
irc_safe_topo_track jet_class jet_class_non_int jet_class_highlevel jet_class_pnet""".split()


def jet_rows(n=40, seed=2):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        k = rng.randrange(1, 9)
        cols = [[rng.uniform(1, 100) for _ in range(k)], [rng.uniform(-2, 2) for _ in range(k)],
                [rng.uniform(-3, 3) for _ in range(k)], [rng.uniform(0, 1) for _ in range(k)]]
        out.append((i, 200.0, 0.3, -0.4, 20.0, 1.0, [1.0, 2.0, 0.5], *cols))
    return out


@pytest.fixture(scope="module")
def jets(spark):
    kinds = ", ".join(f"jets_Constituent_{k} array<double>" for k in ("pt", "eta", "phi", "m"))
    return spark.createDataFrame(
        jet_rows(),
        f"jet_id long, jets_pt double, jets_eta double, jets_phi double, jets_m double, weight double, w array<double>, {kinds}",
    )


def test_registry_is_complete(jets):
    assert set(NAMES) <= set(features.REGISTRY)
    with pytest.raises(ValueError):
        features.add_features(jets, "no_such_set")
    with pytest.raises(ValueError):
        features.add_features(jets, "gnn", max_constituents=None)
    with pytest.raises(ValueError):
        features.add_features(jets, "int_const", engine="other")


def test_own_feature_set(jets):
    features.register("only_pt", lambda df, out, **_: df.withColumn(out, F.struct(F.col("jets_pt").alias("pt"))))
    assert features.add_features(jets, "only_pt").first().features.pt == 200.0
    del features.REGISTRY["only_pt"]


@pytest.mark.parametrize("engine, step", [("builtin", None), ("arrow", 1_000_000), ("arrow", 10)])
def test_pair_matrix_against_numpy(jets, engine, step, monkeypatch):
    if step:
        monkeypatch.setattr(pair_kernel, "PAIRS_PER_STEP", step)
    df = features.add_features(jets.repartition(2), "int_const", engine=engine)
    got = {r.jet_id: r.features.edge for r in df.collect()}
    for row in jet_rows():
        pt, eta, phi, m = (np.array(v) for v in row[7:])
        order = np.argsort(-pt, kind="stable")
        pt, eta, phi, m = pt[order], eta[order], phi[order], m[order]
        p = np.stack([pt * np.cos(phi), pt * np.sin(phi), pt * np.sinh(eta)])
        e = np.sqrt(m**2 + (p**2).sum(axis=0))
        dr = np.hypot(eta[:, None] - eta, phi[:, None] - phi)
        low = np.minimum(pt[:, None], pt)
        m2 = (e[:, None] + e) ** 2 - ((p[:, :, None] + p[:, None, :]) ** 2).sum(axis=0)
        want = {"delta": np.log(np.clip(dr, 1e-10, 1e10)), "k_t": np.log(np.clip(low * dr, 1e-10, 1e10)),
                "z": low / (pt[:, None] + pt), "m2": np.log(np.clip(m2, 1e-10, 1e10))}
        for name, matrix in want.items():
            np.fill_diagonal(matrix, 0.0)
            found = np.array([[c[name] for c in line] for line in got[row[0]]])
            assert np.allclose(found, matrix, atol=1e-6), name


def test_constituents_are_cut_to_the_leading_ones(jets):
    node = features.add_features(jets, "const", max_constituents=2).select("features.node").collect()
    for row, original in zip(node, jet_rows()):
        best = sorted(original[7], reverse=True)[:2]
        assert np.allclose([math.exp(c["log_pT"]) for c in row.node], best)


def test_nan_stays_nan(spark):
    from sparkjets.functions.numeric import clip

    df = spark.createDataFrame([(float("nan"),), (5.0,), (-5.0,)], "x double")
    values = [r.y for r in df.select(clip(F.col("x"), -1.0, 1.0).alias("y")).collect()]
    assert math.isnan(values[0]) and values[1:] == [1.0, -1.0]


def test_augmentations_do_not_depend_on_partitions(jets):
    steps = [("drop_soft", {"prob": 0.7, "center": 0.5}), ("rotation", {"max_angle": 40}), ("boost", {}),
             ("collinear_split", {"amount": 0.5}), ("soft_smear", {"energy_scale": 0.1}), ("pt_smear", {}),
             ("shift_weights", {"weights": "w", "indices": [0, 1, 2]})]
    assert {s for s, _ in steps} == set(AUGMENTATIONS)

    def run(n, seed):
        out = augment(jets.repartition(n), "jet_id", steps, seed)
        return {r.jet_id: (r.weight, r.jets_Constituent_pt, r.jets_Constituent_eta) for r in out.collect()}

    assert run(1, 7) == run(5, 7)
    assert run(1, 7) != run(1, 8)
    with pytest.raises(ValueError):
        augment(jets, "jet_id", [("no_such_step", {})])


def test_energy_follows_a_split(spark):
    df = spark.createDataFrame(
        [(1, [10.0, 4.0], [0.0, 0.1], [0.0, 0.1], [1.0, 1.0], [11.0, 5.0])],
        "k long, jets_Constituent_pt array<double>, jets_Constituent_eta array<double>, jets_Constituent_phi array<double>, "
        "jets_Constituent_m array<double>, jets_Constituent_e array<double>",
    )
    row = augment(df, "k", [("collinear_split", {"amount": 1.0})]).first()
    assert len(row.jets_Constituent_e) == 4
    assert sum(row.jets_Constituent_e) == pytest.approx(16.0) and sum(row.jets_Constituent_pt) == pytest.approx(14.0)
    assert sorted(row.jets_Constituent_m) == [0.0, 0.0, 1.0, 1.0]


def test_nearest_neighbours(spark):
    df = spark.createDataFrame([(1, [(0.0, 0.0), (1.0, 0.0), (0.0, 3.0), (5.0, 5.0)])], "id int, p array<struct<eta:double,phi:double>>")
    near = df.select(pairs.nearest_neighbours(F.col("p"), 2).alias("n")).first().n
    assert [[x["j"] for x in line] for line in near] == [[1, 2], [0, 2], [0, 1], [2, 1]]
    assert near[1][1]["distance"] == pytest.approx(math.sqrt(10))
