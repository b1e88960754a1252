"""Pair matrices computed a batch of jets at a time with Arrow and numpy.

The built-in form in :mod:`sparkjets.functions.features` evaluates a lambda per
pair, which the engine interprets; a jet of 100 constituents has 10 000 pairs.
Here the arrays of a whole batch are one flat vector each, pairs are index
vectors into them, and no Python object is made per jet or per value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkjets.functions.numeric import CLIP_MAX, CLIP_MIN

# Pairs worked on at once: bounds the memory of a task, whatever the jets look like.
PAIRS_PER_STEP = 1_000_000

RETURN_TYPE = "array<array<struct<delta:double,k_t:double,z:double,m2:double>>>"


def _log_clip(x: np.ndarray) -> np.ndarray:
    return np.log(np.clip(x, CLIP_MIN, CLIP_MAX))


def pair_features(
    columns: list[np.ndarray], i: np.ndarray, j: np.ndarray, wrap: bool, log_z: bool
) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Features of the pairs (i, j) and where z has no value; ``columns`` are pt, angle, phi, E, px, py, pz."""
    pt, angle, phi, *p4 = columns
    dphi = phi[i] - phi[j]
    if wrap:
        dphi = np.arctan2(np.sin(dphi), np.cos(dphi))
    dr = np.hypot(angle[i] - angle[j], dphi)
    low, both = np.minimum(pt[i], pt[j]), pt[i] + pt[j]
    energy, px, py, pz = (v[i] + v[j] for v in p4)
    with np.errstate(all="ignore"):
        z = low / both
        values = {
            "delta": _log_clip(dr),
            "k_t": _log_clip(low * dr),
            "z": _log_clip(z) if log_z else z,
            "m2": _log_clip(energy * energy - px * px - py * py - pz * pz),
        }
    return values, both == 0


def _matrix(columns: list[pa.ListArray], wrap: bool, log_z: bool) -> pa.ListArray:
    """Matrices of some jets; ``columns`` are pt, angle, phi, E, px, py, pz."""
    offsets = columns[0].offsets.to_numpy()
    flat = [c.values.slice(c.offsets[0].as_py()).to_numpy(zero_copy_only=False) for c in columns]
    starts = offsets[:-1] - offsets[0]
    lengths = np.diff(offsets)
    per_row = np.repeat(lengths, lengths)  # one matrix row per constituent, as long as its jet
    row_ends = np.cumsum(per_row)
    total = int(row_ends[-1]) if len(row_ends) else 0
    i = np.repeat(np.arange(len(per_row)), per_row)
    j = np.arange(total) - np.repeat(row_ends - per_row, per_row) + np.repeat(np.repeat(starts, lengths), per_row)
    values, undefined = pair_features(flat, i, j, wrap, log_z)
    diagonal = i == j
    for v in values.values():
        v[diagonal] = 0.0
    undefined &= ~diagonal
    arrays = [pa.array(v, mask=undefined if name == "z" else None) for name, v in values.items()]
    cells = pa.StructArray.from_arrays(arrays, names=list(values))
    rows = pa.ListArray.from_arrays(np.concatenate([[0], row_ends]).astype(np.int32), cells)
    return pa.ListArray.from_arrays((offsets - offsets[0]).astype(np.int32), rows)


def _steps(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of jets with at most about PAIRS_PER_STEP pairs together."""
    begin, pairs = 0, 0
    for at, n in enumerate(lengths):
        if at > begin and pairs + n * n > PAIRS_PER_STEP:
            yield begin, at
            begin, pairs = at, 0
        pairs += int(n) * int(n)
    yield begin, len(lengths)


def _kernel(wrap: bool, log_z: bool):
    def run(batches):
        for columns in batches:
            columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
            lengths = np.diff(columns[0].offsets.to_numpy())
            for begin, end in _steps(lengths):
                yield _matrix([c.slice(begin, end - begin) for c in columns], wrap, log_z)

    # the annotation selects the iterator form, which may answer a batch in several pieces
    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return run


def pair_matrix(c: Column, angle: str = "eta", wrap: bool = False, log_z: bool = False) -> Column:
    """The same matrix as the built-in form."""
    udf = F.arrow_udf(_kernel(wrap, log_z), RETURN_TYPE)
    return udf(*[c[k] for k in ("pt", angle, "phi", "E", "px", "py", "pz")])
