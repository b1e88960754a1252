"""Labels, names and class indices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Monte-Carlo particle numbers of the partons a jet can come from.
QUARKS = (1, 2, 3, 4, 5, 6)
GLUON = (21,)
PARTON_LETTERS = {1: "d", 2: "u", 3: "s", 4: "c", 5: "b", 6: "t", 21: "g"}
UNKNOWN_CLASS = -999


def quark_gluon(parton: Column, other=-1) -> Column:
    """1 for a quark, 0 for a gluon, ``other`` otherwise."""
    other = other if isinstance(other, Column) else F.lit(other)
    return F.when(parton.isin(*QUARKS), 1).when(parton.isin(*GLUON), 0).otherwise(other)


def lookup(value: Column, names: Mapping, default=None) -> Column:
    """Replace values by name; values without a name keep their own text unless a default is given."""
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    fallback = value.cast("string") if default is None else F.lit(default)
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), fallback)


def class_index(value: Column, groups: Sequence, unknown: int = UNKNOWN_CLASS) -> Column:
    """Position of the group that holds ``value``; the later group wins when two do."""
    result = F.lit(unknown)
    for k, group in enumerate(groups):
        members = list(group) if isinstance(group, (list, tuple, set, range)) else [group]
        result = F.when(value.cast("int").isin(members), k).otherwise(result)
    return result


def last_flag(flags: Sequence[Column], none: int = -1) -> Column:
    """Position of the last flag that equals one."""
    hits = [F.when(flag.cast("int") == 1, F.lit(k)) for k, flag in enumerate(flags)]
    return F.coalesce(*reversed(hits), F.lit(none))


def predicted_class(score: Column, threshold: float = 0.5) -> Column:
    return (score > threshold).cast("int")
