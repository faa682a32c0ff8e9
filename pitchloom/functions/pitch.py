"""Column expressions on pitch: cents, folding, binning, normalising."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OCTAVE = 1200.0


def cents(f0: Column, sa: Column | float) -> Column:
    """Interval of a pitch above the tonic, in cents."""
    return OCTAVE * F.log2(f0 / (sa if isinstance(sa, Column) else F.lit(float(sa))))


def fold(c: Column) -> Column:
    """Into one octave, never negative."""
    return c - OCTAVE * F.floor(c / OCTAVE)


def histogram_bin(c: Column, n: int) -> Column:
    """Equal-width bins on [0, 1200]; the right edge falls into the last."""
    return F.least(F.floor(c * n / OCTAVE), F.lit(n - 1)).cast("int")


def digitised_bin(c: Column, n: int) -> Column:
    """Equal-width bins on [0, 1200); null outside, so also at 1200."""
    b = F.floor(c * n / OCTAVE).cast("int")
    return F.when((b >= 0) & (b < n), b)


def clipped_bin(c: Column, n: int) -> Column:
    """Equal-width bins; what is outside goes into the first or the last."""
    return F.greatest(F.lit(0), F.least(F.floor(c / (OCTAVE / n)), F.lit(n - 1))).cast("int")


def semitone(b: Column, n: int) -> Column:
    return F.floor(b / (n // 12)).cast("int")


def grid_residual(b: Column, n: int) -> Column:
    """Distance of a bin from the nearest semitone, in cents."""
    k = n // 12
    return F.least(b % k, k - b % k) * (OCTAVE / n)


def octave_candidates(peak: Column, multipliers, low: float, high: float) -> Column:
    """A peak's octave transpositions within the range, as an array of structs ``m, hz``."""
    all_ = F.array(*[F.struct(F.lit(i).alias("m"), (peak * float(x)).alias("hz")) for i, x in enumerate(multipliers)])
    return F.filter(all_, lambda x: (x["hz"] >= low) & (x["hz"] <= high))


def bin_centre(b: Column, low: Column, high: Column, n: int) -> Column:
    return low + (b + 0.5) * (high - low) / n


def wide_window(c: Column) -> Column:
    """The octave below to the octave above, before folding."""
    return (c > -OCTAVE) & (c < 2 * OCTAVE)


def no_nan(x: Column) -> Column:
    """NaN marks a missing pitch in files; here that is null."""
    return F.when(~F.isnan(x), x)
