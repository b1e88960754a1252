"""Pair features in tiles against all pairs of a jet."""

import numpy as np
import oracle
import pytest

import __spark_entry__ as entry
from sparkjets.operators import pair_tiles

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", ["pair_matrix_int_const", "pair_matrix_int_rel_const", "pair_matrix_jetclass", "pair_matrix_builtin_engine", "pair_cells"])
def test_tiny_tiles(spark, data, duck, name, monkeypatch):
    monkeypatch.setattr(pair_tiles, "TILE", 2)
    assert oracle.compare(QUERIES[name](spark, data), duck, ORACLES[name]) is None


def large_jet(n):
    draw = np.random.default_rng(1)
    return [(7, i, float(p), float(e), float(f), 0.1) for i, (p, e, f) in enumerate(zip(draw.exponential(5, n), draw.normal(size=n), draw.uniform(-3, 3, n)))]


def test_a_jet_of_five_thousand(spark, monkeypatch):
    rows = large_jet(5000)
    df = pair_tiles.with_momenta(spark.createDataFrame([*rows, (8, 0, 1.0, 0.0, 0.0, 0.0)], "jet long, i long, pt double, eta double, phi double, m double"))
    tiled = pair_tiles.tiles(df, ["jet"], ["i"])
    sizes = tiled.selectExpr("lo", "hi", "size(a) AS a", "size(b) AS b").collect()
    blocks = -(-5000 // pair_tiles.TILE)
    assert len(sizes) == blocks * (blocks + 1) // 2 + 1  # a triangle of tiles, and the jet of one
    assert max(max(s.a, s.b) for s in sizes) < 2 * pair_tiles.TILE
    assert sum(s.a for s in sizes if s.lo == s.hi) == 5001
    found = {r.jet: r for r in pair_tiles.pair_sums(tiled, ["jet"], {"z": ("z", None, 0.0), "near": ("delta", "k_t", 0.0)}).collect()}
    pt, eta, phi = (np.array([r[k] for r in rows]) for k in (2, 3, 4))
    low, both = np.minimum(pt[:, None], pt), pt[:, None] + pt
    dr = np.sqrt((eta[:, None] - eta) ** 2 + (phi[:, None] - phi) ** 2)
    np.fill_diagonal(dr, 1.0)
    off = ~np.eye(5000, dtype=bool)
    log = lambda x: np.log(np.clip(x, 1e-10, 1e10))
    assert found[7].cells == 25_000_000 and found[8].cells == 1 and found[8].z == 0.0
    assert found[7].z == pytest.approx((low / both)[off].sum(), rel=1e-9)
    assert found[7].near == pytest.approx(log(dr)[off & (log(low * dr) > 0)].sum(), rel=1e-9)


def test_pairs_without_pt(spark):
    rows = [(1, 0, 0.0, 0.0, 0.0, 1.0), (1, 1, 0.0, 1.0, 1.0, 1.0), (1, 2, 2.0, 0.5, 0.0, 0.0)]
    df = pair_tiles.with_momenta(spark.createDataFrame(rows, "jet long, i long, pt double, eta double, phi double, m double"))
    tiled = pair_tiles.tiles(df, ["jet"], ["i"], index="i")
    for engine in ("arrow", "builtin"):
        out = pair_tiles.pair_sums(tiled, ["jet"], {"z": ("z", None, 0.0)}, engine=engine).collect()
        assert [(r.cells, r.z) for r in out] == [(9, 0.0)]
    cells = {(r.i, r.j): r.z for r in pair_tiles.pair_cells(tiled, ["jet"]).collect()}
    assert cells[0, 1] is None and cells[0, 0] == 0.0 and len(cells) == 9


def test_no_constituents(spark):
    df = pair_tiles.with_momenta(spark.createDataFrame([], "jet long, i long, pt double, eta double, phi double, m double"))
    assert pair_tiles.pair_sums(pair_tiles.tiles(df, ["jet"], ["i"]), ["jet"], {"z": ("z", None, 0.0)}).collect() == []
