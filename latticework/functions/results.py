"""Column rules of run statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Geometries by how many times the rank their leaves hold: plane figures, surfaces in space, solids.
LEAF_TIMES = {
    4: ("Square",),
    6: ("SphereSurface", "CubeSurface", "CylinderSurface", "EllipsoidSurface", "Dihedral", "Device", "F16", "RidgedHorn", "EMCCAlmond", "FrigateHull", "Plane"),
    8: ("Sphere", "Cube"),
}


def leaf_size(tolerance: Column, geometry: Column) -> Column:
    """Points allowed in a leaf: 50 below tolerance 1, else 4, 6 or 8 times the rank (the truncated tolerance) as LEAF_TIMES says; other geometries are an error."""
    wrong = F.raise_error(F.concat(F.lit("no leaf size for geometry "), F.coalesce(geometry, F.lit("null")))).cast("long")
    times = F.when(tolerance < 1, F.lit(None).cast("long"))
    for k, names in LEAF_TIMES.items():
        times = times.when(geometry.isin(*names), F.lit(k).cast("long"))
    return F.when(tolerance < 1, F.lit(50).cast("long")).otherwise(times.otherwise(wrong) * F.floor(tolerance))


def compression(ranks: Column, sizes: Column) -> Column:
    """1 - rank / size of two parallel arrays; the shorter one counts, a size of 0 gives null."""
    n = F.least(F.size(ranks), F.size(sizes))
    return F.zip_with(F.slice(ranks, 1, n), F.slice(sizes, 1, n), lambda r, s: 1 - F.try_divide(r.cast("double"), s.cast("double")))


def untracked(total: Column, accounted: Column, stored: Column | None = None) -> Column:
    """max(total - accounted, 0), or the stored value if that is positive."""
    rest = F.greatest(total - accounted, F.lit(0))
    return rest if stored is None else F.when(stored > 0, stored).otherwise(rest)


def magnitude(*parts: Column) -> Column:
    """sum of |part|^2 of complex parts."""
    return sum((p["re"] * p["re"] + p["im"] * p["im"] for p in parts), F.lit(0.0))


def cross_section(square: Column) -> Column:
    """10 log10(4 pi |F|^2)."""
    return 10 * F.log10(4 * math.pi * square)


def valid(x: Column) -> Column:
    """Not null and not NaN."""
    return x.isNotNull() & ~F.isnan(x.cast("double"))


def growth(rect: Column, low: Column, up: Column) -> Column:
    """(1 + |rect| |L| |U|)^2; null unless all three are there."""
    return (1 + rect * low * up) ** 2


def diagonal_growth(low: Column, up: Column) -> Column:
    """As growth with a missing part taken as 1."""
    return (1 + F.coalesce(low, F.lit(1.0)) * F.coalesce(up, F.lit(1.0))) ** 2


def close_to(x: Column, wanted: float) -> Column:
    """|x - wanted| <= 1e-8 + 1e-5 |wanted|; so values up to 1e-8 are all alike."""
    return F.abs(x - wanted) <= 1e-8 + 1e-5 * abs(wanted)
