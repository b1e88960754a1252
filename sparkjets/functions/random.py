"""Random numbers that depend on row keys only.

A draw is a pure function of (seed, keys): the first digits of a digest of their text. A
task that is retried after an executor loss, a plan that runs with other partition
counts, and any other engine that has the digest see the same numbers; SQL states
them as ``md5(concat_ws('/', seed, key, ...))``. ``rand(seed)`` promises none of that.
Keys may be of any type that casts to text; a NULL key is left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digits(count: int, keys, seed: int) -> Column:
    """The first ``count`` hexadecimal digits (15 at most) of the digest, as a whole number."""
    columns = [F.col(k) if isinstance(k, str) else k for k in keys]
    text = F.concat_ws("/", F.lit(str(seed)), *[c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, count), 16, 10).cast("long")


def uniform(*keys, seed: int = 42) -> Column:
    """Uniform double in the open interval (0, 1), of 52 bits."""
    return (_digits(13, keys, seed).cast("double") + F.lit(0.5)) * F.lit(2.0**-52)


def uniform_between(low: float, high: float, *keys, seed: int = 42) -> Column:
    return F.lit(float(low)) + uniform(*keys, seed=seed) * F.lit(float(high) - float(low))


def normal(*keys, seed: int = 42) -> Column:
    """Standard normal from two uniforms (Box-Muller)."""
    u1 = uniform(*keys, F.lit("r"), seed=seed)
    u2 = uniform(*keys, F.lit("a"), seed=seed)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def random_order(*keys, seed: int = 42) -> Column:
    """A shuffle key of 60 bits, spread over all 64-bit integers."""
    return (_digits(15, keys, seed) - F.lit(1 << 59)) * F.lit(16)
