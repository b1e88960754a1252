"""Small numeric helpers shared by the feature and metric code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every logarithm in the feature sets is taken on this range.
CLIP_MIN = 1e-10
CLIP_MAX = 1e10


def clip(x: Column, low: float, high: float) -> Column:
    """Clamp to ``[low, high]``; NaN stays NaN (Spark's ``least`` would hide it)."""
    bounded = F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))
    return F.when(F.isnan(x), x).otherwise(bounded)


def log_clip(x: Column) -> Column:
    """Natural logarithm after clamping to ``[CLIP_MIN, CLIP_MAX]``."""
    return F.log(clip(x, CLIP_MIN, CLIP_MAX))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields NULL for a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def hypot(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)
