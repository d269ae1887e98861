"""Place names to coordinates, and distances between them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidewatch import constants as C
from tidewatch.functions.scalars import at_most

ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑ"
PLAIN = "aaaaaaeeeeiiiiooooouuuucnAAAAAAEEEEIIIIOOOOOUUUUCN"


def _point(lat: float, lon: float) -> str:
    return f"named_struct('lat', {lat}D, 'lon', {lon}D)"


# As SQL text these fold to one literal and take one call to build.
EXACT = "map({})".format(", ".join(f"'{c}', {_point(lat, lon)}" for c, lat, lon in C.CITY_COORDINATES))
KNOWN = "array({})".format(
    ", ".join(
        f"named_struct('name', '{c.lower()}', 'at', {_point(lat, lon)})" for c, lat, lon in C.CITY_COORDINATES
    )
)


def coordinates(place: Column) -> Column:
    """``struct(lat, lon)`` of a "City, CC" name, or null.

    An exact name wins; otherwise the first known place whose name contains the
    city part, ignoring case.  Accents are ignored.  The dimension is a fixed
    list of twenty cities, so it is a folded literal rather than a join.
    """
    plain = F.translate(place, ACCENTED, PLAIN)
    city = F.lower(F.trim(F.split(plain, ",")[0]))
    near = F.try_element_at(F.filter(F.expr(KNOWN), lambda c: F.contains(c["name"], city)), F.lit(1))["at"]
    return F.coalesce(F.try_element_at(F.expr(EXACT), plain), near)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; null when any coordinate is."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * C.EARTH_RADIUS_KM) * F.asin(at_most(F.sqrt(a), 1.0))


def travel_kmh(distance_km: Column, elapsed_us: Column) -> Column:
    """Speed over a positive time span; zero when unknown or not positive."""
    hours = elapsed_us / F.lit(3_600_000_000.0)
    return F.when((elapsed_us > 0) & distance_km.isNotNull(), F.try_divide(distance_km, hours)).otherwise(0.0)
