"""Four-vector conversions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkjets.functions.arrays import let
from sparkjets.functions.numeric import ratio


def cartesian(m: Column, pt: Column, eta: Column, phi: Column) -> dict[str, Column]:
    """(m, pt, eta, phi) -> E, px, py, pz."""
    px, py, pz = pt * F.cos(phi), pt * F.sin(phi), pt * F.sinh(eta)
    return {"E": F.sqrt(m * m + px * px + py * py + pz * pz), "px": px, "py": py, "pz": pz}


def _transverse(E: Column, px: Column, py: Column, pz: Column) -> dict[str, Column]:
    pt2 = px * px + py * py
    return {
        "m": F.sqrt(E * E - pt2 - pz * pz),
        "pt": F.sqrt(pt2),
        "phi": F.atan2(py, px),
    }


def cylindrical(E: Column, px: Column, py: Column, pz: Column) -> dict[str, Column]:
    """(E, px, py, pz) -> m, pt, eta, phi with eta = atanh(pz / |p|)."""
    out = _transverse(E, px, py, pz)
    out["eta"] = F.atanh(ratio(pz, F.sqrt(px * px + py * py + pz * pz)))
    return out


def cylindrical_rapidity(E: Column, px: Column, py: Column, pz: Column) -> dict[str, Column]:
    """(E, px, py, pz) -> m, pt, y, phi with y = ln((E + pz) / (E - pz)) / 2."""
    out = _transverse(E, px, py, pz)
    out["y"] = F.lit(0.5) * F.log(ratio(E + pz, E - pz))
    return out


def delta_phi(a: Column, b: Column) -> Column:
    """Azimuth difference wrapped into (-pi, pi]."""
    return F.atan2(F.sin(a - b), F.cos(a - b))


def cartesian_struct(x: Column) -> Column:
    """E, px, py, pz of one array element with m, pt, eta, phi, each sine taken once."""
    momentum = F.struct(
        x["m"].alias("m"),
        (x["pt"] * F.cos(x["phi"])).alias("px"),
        (x["pt"] * F.sin(x["phi"])).alias("py"),
        (x["pt"] * F.sinh(x["eta"])).alias("pz"),
    )

    def with_energy(p: Column) -> Column:
        squares = p["m"] * p["m"] + p["px"] * p["px"] + p["py"] * p["py"] + p["pz"] * p["pz"]
        return F.struct(F.sqrt(squares).alias("E"), *[p[k].alias(k) for k in ("px", "py", "pz")])

    return let(momentum, with_energy)


def as_struct(parts: dict[str, Column]) -> Column:
    return F.struct(*[value.alias(name) for name, value in parts.items()])
