"""Map algebra on single cells, as column expressions in FLOAT arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import single

# Fixed values of the index and of its stored forms.
INDEX_MIN, INDEX_MAX = -1.0, 1.0
FORMAT_TOLERANCE = 0.02
STORED_SCALE = 10_000.0
STORED_LIMIT = 10_000.0
LEAST_SUM = 1e-10
NODATA = -9999.0
#: Smallest step of FLOAT at 1, below which sums and maxima count as nothing.
FLOAT_STEP = 2.0**-23


# Filters are pushed below projections by putting each column's expression in its place, so these name their arguments
# as few times as they can.


def finite(value: Column) -> Column:
    """Null for null; false for NaN, which compares above everything, and for infinities."""
    return F.abs(value) < F.lit(float("inf"))


def unmasked(raw: Column, nodata: float | None = NODATA, scale: float = 1.0, offset: float = 0.0) -> Column:
    """A stored value as FLOAT: null where it is not finite or close to nodata, which is tested before scaling."""
    value = raw.cast("float")
    keep = finite(value)
    if nodata is not None:
        keep &= F.abs(value - single(nodata)) > F.lit(1e-8 + 1e-5 * abs(nodata))
    scaled = value if (scale, offset) == (1.0, 0.0) else (value * single(scale) + single(offset)).cast("float")
    return F.when(keep, scaled)


def clamp(value: Column, low: float = INDEX_MIN, high: float = INDEX_MAX) -> Column:
    """A value that is not null within bounds."""
    return F.least(F.greatest(value, single(low)), single(high))


def vegetation_index(red: Column, nir: Column) -> Column:
    """(nir - red) / (nir + red) within [-1, 1]; null where a band is missing or not finite, or the sum vanishes."""
    total = nir + red
    ratio = F.try_divide(nir - red, total).cast("float")
    return F.when((F.abs(total) > single(LEAST_SUM)) & finite(total), clamp(ratio))


def in_range(value: Column) -> Column:
    return value.between(single(INDEX_MIN), single(INDEX_MAX))


def change(base: Column, target: Column) -> Column:
    return (target - base).cast("float")


def stored_factor(low: Column, high: Column) -> Column:
    """What to divide a stored index by, from its extremes: 1, or 10 000 for scaled integers; null: no known form.

    Values up to 1.02 in size count as unscaled and are not cut to 1 here.
    """
    edge = F.lit(INDEX_MAX + FORMAT_TOLERANCE)
    return F.when((low >= -edge) & (high <= edge), F.lit(1.0)).when(
        F.greatest(F.abs(low), F.abs(high)) <= F.lit(STORED_LIMIT), F.lit(STORED_SCALE)
    )


def share_of_max(value: Column, largest: Column) -> Column:
    """``value`` over the largest one, 0 where nothing is large; missing values count as 0, negative ones stay."""
    clean = F.when(finite(value), value.cast("double")).otherwise(0.0)
    return F.when(largest > F.lit(FLOAT_STEP), clean / F.nullif(largest, F.lit(0.0))).otherwise(0.0)


def differs(a: Column, b: Column) -> Column:
    """Not close: farther apart than 1e-8 + 1e-5 |b|."""
    return F.abs(a - b) > F.lit(1e-8) + F.lit(1e-5) * F.abs(b)
