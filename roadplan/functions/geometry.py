"""Distances, elevation and segment geometry as Column expressions."""

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The results depend on these exact numbers.
EARTH_RADIUS_M = 6_371_000.0
KM_PER_DEGREE = 111.0
M_PER_DEGREE = 111_000.0
DEM_LAT = (28.6, 31.5)
DEM_LON = (77.5, 81.0)
OUTSIDE_DEM_ELEVATION = 1500
PARALLEL_EPS = 1e-10


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return 2 * EARTH_RADIUS_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def planar_degrees(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Euclidean distance in degrees, without any latitude correction."""
    dlat, dlon = lat2 - lat1, lon2 - lon1
    return F.sqrt(dlat * dlat + dlon * dlon)


def planar_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Flat-earth distance in kilometres."""
    return planar_degrees(lat1, lon1, lat2, lon2) * KM_PER_DEGREE


def in_dem_region(lat: Column, lon: Column) -> Column:
    """Whether a point lies inside the modelled elevation region, edges included."""
    return lat.between(*DEM_LAT) & lon.between(*DEM_LON)


def elevation_proxy(lat: Column, lon: Column) -> Column:
    """Modelled ground elevation in whole metres."""
    ripple = ((lat * lon * 1000) % 400).cast("int") - 200
    height = (300 + (lat - DEM_LAT[0]) * 900 + (lon - DEM_LON[0]) * 100 + ripple).cast("int")
    clamped = F.greatest(F.lit(300), F.least(F.lit(4000), height))
    return F.when(in_dem_region(lat, lon), clamped).otherwise(OUTSIDE_DEM_ELEVATION)


def elevation_proxy_values(lat: np.ndarray, lon: np.ndarray, inside: bool = False) -> np.ndarray:
    """``elevation_proxy`` of arrays, as doubles; a point that isn't a number lies outside. ``inside``: no point lies outside."""
    rest = lat * lon
    rest *= 1000
    whole = rest / 400
    np.trunc(whole, out=whole)
    whole *= 400
    # exact, as is the remainder itself; the quotient may be rounded up to a whole number
    rest -= whole
    if not rest.min(initial=0.0) >= 0:
        rest[rest < 0] += 400
    np.trunc(rest, out=rest)
    rest -= 200
    height = lat - DEM_LAT[0]
    height *= 900
    height += 300
    east = lon - DEM_LON[0]
    east *= 100
    height += east
    height += rest
    np.trunc(height, out=height)
    np.maximum(height, 300, out=height)
    np.minimum(height, 4000, out=height)
    if not inside:
        within = (lat >= DEM_LAT[0]) & (lat <= DEM_LAT[1]) & (lon >= DEM_LON[0]) & (lon <= DEM_LON[1])
        height[~within] = OUTSIDE_DEM_ELEVATION
    return height


def round_places(value: Column, places: int) -> Column:
    """Round half away from zero by plain arithmetic, which stays cheap over billions of stations."""
    scale = float(10 ** places)
    return F.when(value < 0, -F.floor(0.5 - value * scale) / scale).otherwise(F.floor(value * scale + 0.5) / scale)


def lerp(a: Column, b: Column, t: Column) -> Column:
    """Point at fraction ``t`` of the way from ``a`` to ``b``."""
    return a + t * (b - a)


def cross(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Twice the signed area between two vectors."""
    return ax * by - ay * bx


def meeting(
    p1_lat: Column, p1_lon: Column, p2_lat: Column, p2_lon: Column,
    q1_lat: Column, q1_lon: Column, q2_lat: Column, q2_lon: Column,
) -> tuple[Column, Column, Column]:
    """Whether segments p and q meet, end points included, and the latitude and longitude where they do.

    With p = P + s a and q = Q + r b, crossing both sides of P + s a = Q + r b with b and with a leaves one unknown each.
    """
    a, b = (p2_lon - p1_lon, p2_lat - p1_lat), (q2_lon - q1_lon, q2_lat - q1_lat)
    between = (q1_lon - p1_lon, q1_lat - p1_lat)
    area = cross(*a, *b)
    along_p, along_q = (F.try_divide(cross(*between, *side), area) for side in (b, a))
    inside = F.abs(area) >= PARALLEL_EPS
    for part in (along_p, along_q):
        inside &= (part >= 0) & (part <= 1)
    return inside, lerp(p1_lat, p2_lat, along_p), lerp(p1_lon, p2_lon, along_p)


def intersection(*ends: Column) -> Column:
    """``struct(lat, lon)`` of the meeting point of two segments, otherwise null."""
    hit, lat, lon = meeting(*ends)
    return F.when(hit, F.struct(lat.alias("lat"), lon.alias("lon")))


def point_segment_degrees(
    lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column
) -> Column:
    """Distance in degrees from a point to a segment, measured to its ends beyond them."""
    side, to_point = (lon2 - lon1, lat2 - lat1), (lon - lon1, lat - lat1)
    dot = lambda u, v: u[0] * v[0] + u[1] * v[1]
    share = F.try_divide(dot(to_point, side), dot(side, side))
    on_segment = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(share, F.lit(0.0))))
    return planar_degrees(lerp(lat1, lat2, on_segment), lerp(lon1, lon2, on_segment), lat, lon)
