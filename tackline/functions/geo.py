"""Great-circle geometry on a sphere, in degrees, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tackline.functions.canonical import col, wrap_360

#: Fixed values.
EARTH_RADIUS_M = 6_371_229.0
KNOT_M_S = 1852.0 / 3600.0
SAME_PLACE_M = 1e-6


def distance_m(lat1, lon1, lat2, lon2) -> Column:
    """Haversine distance in metres."""
    phi1, phi2 = F.radians(col(lat1)), F.radians(col(lat2))
    half_lat, half_lon = F.sin((phi2 - phi1) / 2.0), F.sin(F.radians(col(lon2) - col(lon1)) / 2.0)
    a = half_lat * half_lat + F.cos(phi1) * F.cos(phi2) * (half_lon * half_lon)
    return 2.0 * EARTH_RADIUS_M * F.atan2(F.sqrt(a), F.sqrt(F.greatest(1.0 - a, F.lit(0.0))))


def initial_bearing(lat1, lon1, lat2, lon2) -> Column:
    """Direction of travel on leaving the first position; null where both are one place."""
    phi1, phi2, lam = F.radians(col(lat1)), F.radians(col(lat2)), F.radians(col(lon2) - col(lon1))
    y = F.sin(lam) * F.cos(phi2)
    x = F.cos(phi1) * F.sin(phi2) - F.sin(phi1) * F.cos(phi2) * F.cos(lam)
    return F.when(distance_m(lat1, lon1, lat2, lon2) >= SAME_PLACE_M, wrap_360(F.degrees(F.atan2(y, x))))


def final_bearing(lat1, lon1, lat2, lon2) -> Column:
    """Direction of travel on arriving at the second position."""
    return wrap_360(initial_bearing(lat2, lon2, lat1, lon1) + 180.0)


def mean_direction(a, b) -> Column:
    """Circular mean of two directions; null where they are opposite."""
    a, b = F.radians(col(a)), F.radians(col(b))
    y, x = F.sin(a) + F.sin(b), F.cos(a) + F.cos(b)
    return F.when(F.hypot(y, x) > 1e-9, wrap_360(F.degrees(F.atan2(y, x))))
