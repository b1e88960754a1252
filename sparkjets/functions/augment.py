"""Random changes of the constituents of a jet, for training.

Every draw is a hash of (row key, step, element index, seed): a retried task
produces the same jet, and two runs with different partitioning agree.
All work stays inside the row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkjets.functions import vectors
from sparkjets.functions.arrays import let, zip_columns
from sparkjets.functions.constituents import by_descending_pt, collection_columns
from sparkjets.functions.numeric import clip, ratio
from sparkjets.functions.random import normal, uniform, uniform_between

Augmentation = Callable[..., DataFrame]


def _with_constituents(df: DataFrame, const_name: str, change: Callable[[Column], Column], when: Column | None):
    """Zip the four kinematic columns (and the energy, if there), change them, unzip them."""
    columns = collection_columns(const_name)
    energy = f"jets_{const_name}_e"
    if energy in df.columns:
        columns["e"] = energy
    work = df.withColumn("_old", zip_columns(columns)).withColumn("_new", change(F.col("_old")))
    if when is not None:
        work = work.withColumn("_new", F.when(when, F.col("_new")).otherwise(F.col("_old")))
    return work.withColumns({c: F.col("_new")[f] for f, c in columns.items()}).drop("_old", "_new")


def _with_fields(x: Column, changes: Mapping[str, Column]) -> Column:
    for name, value in changes.items():
        x = x.withField(name, value)
    return x


def drop_soft(df, key, const_name="Constituent", min_number=0, skew=1.0, center=1.0, seed=42, when=None):
    """Drop constituents with a probability that rises along the pt order.

    Left alone when the jet has fewer than ``min_number`` constituents or when
    nothing would remain.
    """

    def change(c: Column) -> Column:
        middle = F.size(c).cast("double") * F.lit(float(center))
        drawn = F.transform(c, lambda x, i: F.struct(x.alias("x"), i.alias("i"), uniform(key, i, seed=seed).alias("u")))
        kept = F.filter(
            drawn,
            lambda d: d["u"] > F.lit(1.0) - F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(float(skew)) * (d["i"] - middle))),
        )
        survivors = F.transform(kept, lambda d: d["x"])
        untouched = (F.size(c) < min_number) | (F.size(survivors) == 0)
        return F.when(untouched, c).otherwise(survivors)

    return _with_constituents(df, const_name, change, when)


def rotation(df, key, const_name="Constituent", max_angle=1.0, seed=42, when=None):
    """Rotate all constituents about the summed momentum by one random angle (degrees at most ``max_angle``)."""
    theta = uniform_between(0.0, max_angle * math.pi / 180.0, key, seed=seed)

    def change(c: Column) -> Column:
        momenta = F.transform(c, lambda x: F.struct(x.alias("x"), vectors.cartesian_struct(x).alias("p")))
        zero = F.struct(*[F.lit(0.0).alias(k) for k in ("px", "py", "pz")])

        def turn(items: Column) -> Column:
            sums = F.aggregate(
                items, zero, lambda acc, i: F.struct(*[(acc[k] + i["p"][k]).alias(k) for k in ("px", "py", "pz")])
            )
            with_length = let(
                sums,
                lambda s: F.struct(
                    s.alias("s"), F.sqrt(s["px"] * s["px"] + s["py"] * s["py"] + s["pz"] * s["pz"]).alias("length")
                ),
            )
            axis = let(
                with_length,
                lambda w: F.struct(
                    *[ratio(w["s"][f"p{n}"], w["length"]).alias(n) for n in "xyz"],
                    F.cos(theta).alias("cos"),
                    F.sin(theta).alias("sin"),
                ),
            )
            return let(axis, lambda f: F.transform(items, lambda i: rotated(f, i)))

        def rotated(f: Column, i: Column) -> Column:
            p = i["p"]
            along = (f["x"] * p["px"] + f["y"] * p["py"] + f["z"] * p["pz"]) * (F.lit(1.0) - f["cos"])
            turned = {
                "E": p["E"],
                "px": f["cos"] * p["px"] + f["sin"] * (f["y"] * p["pz"] - f["z"] * p["py"]) + f["x"] * along,
                "py": f["cos"] * p["py"] + f["sin"] * (f["z"] * p["px"] - f["x"] * p["pz"]) + f["y"] * along,
                "pz": f["cos"] * p["pz"] + f["sin"] * (f["x"] * p["py"] - f["y"] * p["px"]) + f["z"] * along,
            }
            return _moved(i["x"], vectors.as_struct(turned))

        return let(momenta, turn)

    return _with_constituents(df, const_name, change, when)


def _moved(x: Column, momentum: Column) -> Column:
    """The element with direction and pt of a new momentum; its mass stays."""

    def apply(q: Column) -> Column:
        v = vectors.cylindrical(*[q[k] for k in ("E", "px", "py", "pz")])
        return _with_fields(x, {k: v[k] for k in ("pt", "eta", "phi")})

    return let(momentum, apply)


def boost(df, key, const_name="Constituent", max_beta=0.1, seed=42, when=None):
    """Lorentz boost of all constituents in one random direction."""
    n = [normal(key, F.lit(axis), seed=seed) for axis in "xyz"]
    length = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    beta = uniform_between(0.0, max_beta, key, F.lit("beta"), seed=seed)

    def change(c: Column) -> Column:
        frame = F.struct(
            *[(beta * ratio(component, length)).alias(name) for component, name in zip(n, "xyz")],
            beta.alias("beta"),
            (F.lit(1.0) / F.sqrt(F.lit(1.0) - beta * beta)).alias("gamma"),
        )

        def shifted(f: Column, x: Column) -> Column:
            def apply(p: Column) -> Column:
                along = f["x"] * p["px"] + f["y"] * p["py"] + f["z"] * p["pz"]
                return let(
                    F.struct(
                        p.alias("p"),
                        along.alias("along"),
                        ((f["gamma"] - 1.0) * ratio(along, f["beta"] * f["beta"]) - f["gamma"] * p["E"]).alias("push"),
                    ),
                    lambda b: _moved(
                        x,
                        F.struct(
                            (f["gamma"] * (b["p"]["E"] - b["along"])).alias("E"),
                            *[(b["p"][f"p{n}"] + f[n] * b["push"]).alias(f"p{n}") for n in "xyz"],
                        ),
                    ),
                )

            return let(vectors.cartesian_struct(x), apply)

        return let(frame, lambda f: F.transform(c, lambda x: shifted(f, x)))

    return _with_constituents(df, const_name, change, when)


def collinear_split(df, key, const_name="Constituent", amount=0.1, seed=42, when=None):
    """Split constituents in two along their direction; the new one is massless. The pt sum is unchanged."""
    has_energy = f"jets_{const_name}_e" in df.columns

    def change(c: Column) -> Column:
        drawn = F.transform(
            c,
            lambda x, i: F.struct(
                x.alias("x"),
                (uniform(key, i, F.lit("split"), seed=seed) < F.lit(float(amount))).alias("split"),
                uniform_between(0.1, 0.9, key, i, F.lit("share"), seed=seed).alias("f"),
            ),
        )

        def scaled(x: Column, factor: Column, massless: bool) -> Column:
            changes = {"pt": x["pt"] * factor}
            if has_energy:
                changes["e"] = x["e"] * factor
            if massless:
                changes["m"] = F.lit(0.0)
            return _with_fields(x, changes)

        first = F.transform(drawn, lambda d: scaled(d["x"], F.when(d["split"], d["f"]).otherwise(1.0), False))
        new = F.transform(
            F.filter(drawn, lambda d: d["split"]), lambda d: scaled(d["x"], F.lit(1.0) - d["f"], True)
        )
        return by_descending_pt(F.concat(first, new))

    return _with_constituents(df, const_name, change, when)


def soft_smear(df, key, const_name="Constituent", energy_scale=100.0, seed=42, when=None):
    """Smear directions with a width of ``energy_scale / pt``."""

    def change(c: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            width = ratio(F.lit(float(energy_scale)), x["pt"])
            eta = x["eta"] + width * normal(key, i, F.lit("eta"), seed=seed)
            phi = x["phi"] + width * normal(key, i, F.lit("phi"), seed=seed)
            return _with_fields(x, {"eta": clip(eta, -5.0, 5.0), "phi": clip(phi, -math.pi, math.pi)})

        return F.transform(c, one)

    return _with_constituents(df, const_name, change, when)


def pt_smear(df, key, const_name="Constituent", std_pt_frac=0.1, seed=42, when=None):
    """Smear pt with a width proportional to it."""

    def change(c: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            pt = x["pt"] * (F.lit(1.0) + F.lit(float(std_pt_frac)) * normal(key, i, F.lit("pt"), seed=seed))
            return _with_fields(x, {"pt": clip(pt, 1e-8, 1e8)})

        return F.transform(c, one)

    return _with_constituents(df, const_name, change, when)


def shift_weights(df, key, weights, weight="weight", indices: int | Sequence[int] = 0, nominal=0, seed=42, when=None):
    """Scale the training weight by a systematic variation; one of ``indices`` is drawn per row."""
    options = [indices] if isinstance(indices, int) else list(indices)
    if len(options) == 1:
        position = F.lit(options[0])
    else:
        pick = F.floor(uniform(key, F.lit("shift"), seed=seed) * len(options)).cast("int")
        position = F.get(F.array(*[F.lit(i) for i in options]), pick)
    factor = ratio(F.get(F.col(weights), position), F.get(F.col(weights), F.lit(nominal)))
    if when is not None:
        factor = F.when(when, factor).otherwise(1.0)
    return df.withColumn(weight, F.col(weight) * factor)


AUGMENTATIONS: dict[str, Augmentation] = {
    "drop_soft": drop_soft,
    "rotation": rotation,
    "boost": boost,
    "collinear_split": collinear_split,
    "soft_smear": soft_smear,
    "pt_smear": pt_smear,
    "shift_weights": shift_weights,
}


def augment(df: DataFrame, key: str, steps: Sequence[tuple[str, Mapping]], seed: int = 42) -> DataFrame:
    """Apply named steps in order; an option ``prob`` makes a step apply to that share of the rows."""
    for name, _ in steps:
        if name not in AUGMENTATIONS:
            raise ValueError(f"unknown augmentation {name!r}; known: {', '.join(AUGMENTATIONS)}")
    for number, (name, options) in enumerate(steps):
        options = dict(options)
        chance = options.pop("prob", 1.0)
        step_seed = seed + 1000 * number
        when = None if chance >= 1.0 else uniform(key, F.lit("apply"), seed=step_seed) < F.lit(float(chance))
        df = AUGMENTATIONS[name](df, key, seed=step_seed, when=when, **options)
    return df
