"""Waypoint generation and thinning.

Waypoint lists are short by construction (at most 25), so they live in one array column per route
and every operator here stays inside the row: no shuffle.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadplan.functions.geometry import elevation_proxy, lerp, round_places

KEY = ["route_id", "variant"]

# Points kept and curve strength per variant.
CURVES = {"shortest": (6, 0.08), "safest": (8, 0.12)}
VARIANT_ORDER = {"shortest": 1, "safest": 2}
MAX_WAYPOINTS = 25
PATH_SAMPLES = 10


def resample_indices(n: int, keep: int) -> list[int]:
    """Indices kept when ``n`` points are thinned to ``keep`` evenly spaced ones."""
    return [i * (n - 1) // (keep - 1) for i in range(keep)]


def curve_offset(t: float, strength: float, variant: str) -> float:
    """Sideways bend at fraction ``t``, in units of the straight line's length."""
    if variant == "safest":
        return math.sin(t * math.pi * 2) * strength * 0.5 + math.sin(t * math.pi * 3) * strength * 0.3
    return math.sin(t * math.pi) * strength + math.sin(t * math.pi * 2) * strength * 0.3


def curve_template(variant: str) -> Column:
    """Literal array of ``(seq, t, bend)`` for the kept points of a curve."""
    keep, strength = CURVES[variant]
    points = 2 * keep
    rows = []
    for seq, index in enumerate(resample_indices(points, keep)):
        t = index / (points - 1)
        rows.append(F.struct(
            F.lit(seq).alias("seq"), F.lit(t).alias("t"),
            F.lit(curve_offset(t, strength, variant)).alias("bend"),
        ))
    return F.array(*rows)


def curve_waypoints(variant: str) -> Column:
    """Bent line from start to end; elevation is taken before the coordinates are rounded."""
    dlat, dlon = F.col("end_lat") - F.col("start_lat"), F.col("end_lon") - F.col("start_lon")
    exact = F.transform(curve_template(variant), lambda p: F.struct(
        p.seq.alias("seq"),
        (F.col("start_lat") + dlat * p.t + p.bend * dlon).alias("lat"),
        (F.col("start_lon") + dlon * p.t - p.bend * dlat).alias("lon"),
    ))
    return F.transform(exact, lambda p: F.struct(
        p.seq.alias("seq"),
        round_places(p.lat, 5).alias("lat"),
        round_places(p.lon, 5).alias("lon"),
        elevation_proxy(p.lat, p.lon).alias("elevation"),
    ))


def straight_samples() -> Column:
    """Eleven evenly spaced points on the straight line."""
    return F.transform(F.sequence(F.lit(0), F.lit(PATH_SAMPLES)), lambda i: F.struct(
        i.alias("seq"),
        lerp(F.col("start_lat"), F.col("end_lat"), i / PATH_SAMPLES).alias("lat"),
        lerp(F.col("start_lon"), F.col("end_lon"), i / PATH_SAMPLES).alias("lon"),
    ))


def elevations(waypoints: Column) -> Column:
    return F.transform(waypoints, lambda p: p.elevation)


def explode_waypoints(routes: DataFrame, *extra: str) -> DataFrame:
    """One row per waypoint, with the route key."""
    return routes.select(*KEY, *extra, F.inline("waypoints"))


def legs(waypoints: Column) -> Column:
    """Neighbouring waypoint pairs as ``(seg, lat1, lon1, lat2, lon2)``."""
    n = F.greatest(F.size(waypoints) - 1, F.lit(0))
    return F.transform(
        F.arrays_zip(F.slice(waypoints, 1, n).alias("a"), F.slice(waypoints, 2, n).alias("b")),
        lambda z, i: F.struct(
            i.alias("seg"), z["a"].lat.alias("lat1"), z["a"].lon.alias("lon1"),
            z["b"].lat.alias("lat2"), z["b"].lon.alias("lon2"),
        ),
    )


def keep_when_thinned(index: Column, n: Column) -> Column:
    """Whether position ``index`` of ``n`` survives thinning to 25 points."""
    inner = MAX_WAYPOINTS - 1
    step = F.floor(n / inner)
    return (n <= MAX_WAYPOINTS) | (index == 0) | (index == n - 1) | (
        (index % step == 0) & (index / step).between(1, inner - 1)
    )


def collapse_repeats(points: DataFrame, *order: str) -> DataFrame:
    """Drop a point that repeats the one before it; ``order`` sorts the points of a route."""
    window = W.partitionBy(*KEY).orderBy(*order)
    same = (F.lag("lat").over(window) == F.col("lat")) & (F.lag("lon").over(window) == F.col("lon"))
    return points.withColumn("same", F.coalesce(same, F.lit(False))).where(~F.col("same")).drop("same")


def thin_points(points: DataFrame, *order: str) -> DataFrame:
    """At most 25 points per route, both ends included, renumbered by ``seq``."""
    window = W.partitionBy(*KEY).orderBy(*order)
    numbered = points.withColumn("at", F.row_number().over(window) - 1).withColumn(
        "n", F.count("*").over(W.partitionBy(*KEY))
    )
    kept = numbered.where(keep_when_thinned(F.col("at"), F.col("n")))
    return kept.withColumn("seq", F.row_number().over(window) - 1).drop("at", "n")


def number_points(points: DataFrame, *order: str) -> DataFrame:
    """All points of a route, numbered by ``seq``."""
    return points.withColumn("seq", F.row_number().over(W.partitionBy(*KEY).orderBy(*order)) - 1)


def waypoint_arrays(points: DataFrame) -> DataFrame:
    """Gather the points of each route back into an array with modelled elevations."""
    point = F.struct("seq", "lat", "lon", elevation_proxy(F.col("lat"), F.col("lon")).alias("elevation"))
    return points.groupBy(*KEY).agg(F.array_sort(F.collect_list(point)).alias("waypoints"))
