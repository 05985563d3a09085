"""Great circles, angles and longitudes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed physical values: Earth's radius (m) and rotation (1/s), R/c_p, gas constant and heat capacity of dry air.
RADIUS, OMEGA, KAPPA, R_DRY, C_P = 6.371e6, 7.2921e-5, 0.2854, 287.0500676, 1005.0


def degcos(x: Column) -> Column:
    return F.cos(F.radians(x))


def degsin(x: Column) -> Column:
    return F.sin(F.radians(x))


def wrap_lon(lon: Column) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def lon_diff(a: Column, b: Column) -> Column:
    """Signed shortest way from ``b`` to ``a``."""
    return wrap_lon(a - b)


def haversine_from_diff(dlon: Column, lat1: Column, lat2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2.0) + degcos(lat1) * degcos(lat2) * F.pow(F.sin(F.radians(dlon) / 2), 2.0)
    return F.asin(F.sqrt(F.when(h > 1.0, 1.0).otherwise(h))) * (2 * RADIUS)  # null where a point is


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres."""
    return haversine_from_diff(lon2 - lon1, lat1, lat2)


def flat_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Distance in degrees on a plate carree map, over the shorter way round."""
    return F.sqrt(F.pow(lon_diff(lon2, lon1), 2.0) + F.pow(lat2 - lat1, 2.0))


def destination(lon: Column, lat: Column, bearing: Column, distance: Column) -> tuple[Column, Column]:
    """(lon, lat) in degrees after ``distance`` metres from a point; ``bearing`` in radians east of north."""
    d = distance / RADIUS
    new = F.asin(degsin(lat) * F.cos(d) + degcos(lat) * F.sin(d) * F.cos(bearing))
    shift = F.atan2(F.sin(bearing) * F.sin(d) * degcos(lat), F.cos(d) - degsin(lat) * F.sin(new))
    return wrap_lon(lon + F.degrees(shift)), F.degrees(new)


def potential_temperature(t: Column, level_hpa: Column) -> Column:
    return t * F.pow(F.lit(1000.0) / level_hpa, F.lit(KAPPA))


def air_density(pressure_pa: Column, t: Column) -> Column:
    return pressure_pa / (R_DRY * t)


def wind_speed(u: Column, v: Column) -> Column:
    return F.hypot(u, v)


def coriolis(lat: Column) -> Column:
    return 2 * OMEGA * degsin(lat)
