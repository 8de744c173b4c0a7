"""Great-circle distances in kilometres."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# The two distances use different earth radii and values of pi.
RADIUS_ROUNDED_KM = 6371.0
RADIUS_RAW_KM = 6370.99681
PI_RAW = 3.1415926


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _acos(cosine: Column) -> Column:
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine)))


def dist_km_4(lon1, lat1, lon2, lat2) -> Column:
    """Spherical law of cosines, rounded to 4 decimals; 0 for equal points."""
    lon1, lat1, lon2, lat2 = map(_col, (lon1, lat1, lon2, lat2))
    rad = F.lit(math.pi / 180)
    a, b = rad * lat1, rad * lat2
    cosine = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(rad * lon2 - rad * lon1)
    same = (lat1 == lat2) & (lon1 == lon2)
    return F.when(same, F.lit(0.0)).otherwise(F.round(_acos(cosine) * F.lit(RADIUS_ROUNDED_KM), 4))


def dist_km_raw(lon1, lat1, lon2, lat2) -> Column:
    """Dot product of the two unit vectors, not rounded; 0 for equal points."""
    lon1, lat1, lon2, lat2 = map(_col, (lon1, lat1, lon2, lat2))

    def rad(c: Column) -> Column:
        return c * F.lit(PI_RAW) / F.lit(180.0)

    a, x, b, y = rad(lat1), rad(lon1), rad(lat2), rad(lon2)
    cosine = (
        F.cos(a) * F.cos(x) * F.cos(b) * F.cos(y)
        + F.cos(a) * F.sin(x) * F.cos(b) * F.sin(y)
        + F.sin(a) * F.sin(b)
    )
    same = (lat1 == lat2) & (lon1 == lon2)
    return F.when(same, F.lit(0.0)).otherwise(_acos(cosine) * F.lit(RADIUS_RAW_KM))


def speed_ms(km: Column, seconds: Column) -> Column:
    """Metres per second; 0 where distance or time is 0."""
    return F.coalesce(km * 1000 / F.nullif(seconds, F.lit(0)), F.lit(0.0))
