"""Great-circle distance and coarse directions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres.
EARTH_RADIUS = 6_371_000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda d: F.pow(F.sin(F.radians(d) / 2), F.lit(2.0))
    a = half(lat2 - lat1) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon2 - lon1)
    return F.lit(EARTH_RADIUS) * 2 * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))


def direction_ns_first(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Along the axis of the larger change; a tie goes to N/S, one point to S."""
    dlat, dlon = lat2 - lat1, lon2 - lon1
    return F.when(F.abs(dlat) >= F.abs(dlon), F.when(dlat > 0, "N").otherwise("S")).otherwise(F.when(dlon > 0, "E").otherwise("W"))


def direction_ew_first(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Along the axis of the larger change; a tie goes to E/W, one point to W."""
    dlat, dlon = lat2 - lat1, lon2 - lon1
    return F.when(F.abs(dlat) > F.abs(dlon), F.when(dlat > 0, "N").otherwise("S")).otherwise(F.when(dlon > 0, "E").otherwise("W"))
