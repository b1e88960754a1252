"""Constituents of a jet as one ``array<struct<m, pt, eta, phi, kind>>`` column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

KINEMATICS = ("m", "pt", "eta", "phi")


def collection_columns(kind: str, jet: str = "jets") -> dict[str, str]:
    return {k: f"{jet}_{kind}_{k}" for k in KINEMATICS}


def by_descending_pt(array: Column) -> Column:
    """Sort by pt, largest first; equal pt keep their order.

    Natural ordering on a (-pt, position) prefix: a comparator lambda would be
    interpreted once per comparison.
    """
    keyed = F.transform(array, lambda c, i: F.struct((-c["pt"]).alias("neg_pt"), i.alias("i"), c.alias("c")))
    return F.transform(F.sort_array(keyed), lambda k: k["c"])


def _keyed(kind: str, number: int, jet: str) -> Column:
    """One collection as structs that sort by descending pt, then collection, then position."""
    columns = collection_columns(kind, jet)

    def one(c: Column, i: Column) -> Column:
        pt = c[columns["pt"]].cast("double")
        return F.struct(
            (-pt).alias("neg_pt"),
            F.lit(number).alias("kind"),
            i.alias("i"),
            *[c[columns[k]].cast("double").alias(k) for k in KINEMATICS],
        )

    return F.transform(F.arrays_zip(*[F.col(c) for c in columns.values()]), one)


def ordered(kinds: Sequence[str], max_constituents: int | None = None, jet: str = "jets") -> Column:
    """All collections together, sorted by pt, cut to ``max_constituents``; the sort keys stay in the structs."""
    collections = [_keyed(kind, number, jet) for number, kind in enumerate(kinds)]
    everything = F.sort_array(collections[0] if len(collections) == 1 else F.concat(*collections))
    return everything if max_constituents is None else F.slice(everything, 1, max_constituents)


def merged(kinds: Sequence[str], max_constituents: int | None = None, jet: str = "jets") -> Column:
    """Like :func:`ordered`, as ``array<struct<m, pt, eta, phi, kind>>``; ``kind`` numbers the collection."""
    fields = [*KINEMATICS, "kind"]
    return F.transform(
        ordered(kinds, max_constituents, jet), lambda c: F.struct(*[c[f].alias(f) for f in fields])
    )


def type_fields(c: Column, kinds: Sequence[str]) -> list[Column]:
    """Type features: none for one collection, a flag for two, a one-hot for more."""
    if len(kinds) == 1:
        return []
    if len(kinds) == 2:
        return [c["kind"].cast("double").alias(f"is_{kinds[1]}")]
    return [(c["kind"] == i).cast("double").alias(f"is_{kind}") for i, kind in enumerate(kinds)]
