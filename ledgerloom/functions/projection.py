"""Queue projections: waits by pace, range modes (F72, F73, RC7)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def waits(gap_days: Column, fast: Column, typical: Column, slow: Column) -> Column:
    """Years to wait at three paces, with floors, repaired order and caps."""
    gap = F.greatest(F.lit(0.0), gap_days / F.lit(365.25))
    f, t, s = F.greatest(F.lit(0.15), fast), F.greatest(F.lit(0.10), typical), F.greatest(F.lit(0.06), slow)
    return F.struct(F.least(F.lit(60.0), gap / F.greatest(f, t)).alias("fast"), F.least(F.lit(70.0), gap / t).alias("typical"), F.least(F.lit(80.0), gap / F.least(s, t)).alias("slow"))


def range_mode(low: Column, typical: Column, high: Column, horizon: Column) -> Column:
    """bounded, partial, beyond-with-floor or beyond, on rounded final years."""
    return F.when(high <= horizon, "bounded").when(typical <= horizon, "partial").when(low <= horizon, "beyond-with-floor").otherwise("beyond")
