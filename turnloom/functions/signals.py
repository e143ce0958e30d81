"""Column functions on facial signals and effect scales. NaN is turned to null on the way in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z_CAP = 0.999
PRESENT = 0.5


def present(x: Column) -> Column:
    """x, or null where it is NaN."""
    return F.when(~F.isnan(x), x)


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def smile_intensity(a06: Column, a12: Column) -> Column:
    """Mean of the two intensities; one missing: the other."""
    a, b = present(a06), present(a12)
    return F.coalesce((a + b) / 2, a, b)


def smile_presence(c06: Column, c12: Column) -> Column:
    """1.0 if both units are present, 0.0 if not, null if either is missing."""
    a, b = finite(c06), finite(c12)
    return F.when(a.isNotNull() & b.isNotNull(), F.when((a >= PRESENT) & (b >= PRESENT), 1.0).otherwise(0.0))


def fisher_z(r: Column, cap: float = Z_CAP) -> Column:
    return F.atanh(F.least(F.greatest(r, F.lit(-cap)), F.lit(cap)))


def cohens_q(r1: Column, r2: Column) -> Column:
    return F.atanh(r1) - F.atanh(r2)


def succ_fail_any(k: Column, n: Column) -> list[Column]:
    return [k.cast("int").alias("succ"), F.greatest(n - k, F.lit(0)).cast("int").alias("fail"), (k > 0).cast("int").alias("any")]


def pooled_d(n1: Column, m1: Column, s1: Column, n2: Column, m2: Column, s2: Column) -> Column:
    """Cohen's d with pooled variance; null without two values on each side or without spread."""
    spread = F.sqrt(((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2) / (n1 + n2 - 2))
    return F.when((n1 > 1) & (n2 > 1) & (spread > 0), (m1 - m2) / spread)


def signed_corr(x: Column, y: Column, least: int = 3, flat: float = 1e-12) -> Column:
    """Aggregate: Pearson r over rows with both finite; null for fewer than `least` or a flat side."""
    a, b = finite(x), finite(y)
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    sa, sb = F.stddev_pop(a), F.stddev_pop(b)
    return F.when((F.count(a) >= least) & (sa >= flat) & (sb >= flat), F.covar_pop(a, b) / (sa * sb))
