"""How much of a route follows existing roads."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadplan.functions.geometry import planar_km, round_places
from roadplan.operators.polyline import KEY, explode_waypoints, legs
from roadplan.operators.spatial import cell_of, split_hot_cells
from roadplan.sources.defaults import CORRIDOR_DEGREES, CORRIDOR_ENDS


def near_corridor(lat: Column, lon: Column, ends=CORRIDOR_ENDS) -> Column:
    """Whether a point lies in the box around either end of a major route, edges excluded."""
    inside = F.lit(False)
    for end_lat, end_lon in ends:
        inside = inside | (
            (F.abs(lat - end_lat) < CORRIDOR_DEGREES) & (F.abs(lon - end_lon) < CORRIDOR_DEGREES)
        )
    return inside


def road_utilization(waypoints: Column, existing: Callable[[Column], Column] | None = None) -> Column:
    """Struct of total, existing and new kilometres, share and savings for a waypoint array.

    ``existing`` tells of a leg whether a road is there; by default that of the built-in major routes.
    """
    known = existing or (lambda g: near_corridor(g.lat1, g.lon1) | near_corridor(g.lat2, g.lon2))
    measured = F.transform(legs(waypoints), lambda g: F.struct(
        planar_km(g.lat1, g.lon1, g.lat2, g.lon2).alias("km"), known(g).alias("existing"),
    ))
    zero = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("existing"))
    return F.aggregate(
        measured, zero,
        lambda acc, g: F.struct(
            (acc.total + g.km).alias("total"),
            (acc.existing + F.when(g.existing, g.km).otherwise(0.0)).alias("existing"),
        ),
        summarize,
    )


def corridor_utilization(routes: DataFrame, major_routes: DataFrame) -> DataFrame:
    """Road utilization of every route against a table of major routes of any size.

    The box around each end of a major route is copied to the cells it touches, and waypoints find it by an equi-join.
    """
    c = F.col
    ends = major_routes.select(F.inline(F.array(*[
        F.struct(c(f"{side}_lat").alias("t_lat"), c(f"{side}_lon").alias("t_lon")) for side in ("start", "end")
    ]))).distinct()
    around = lambda value: F.explode(F.sequence(
        cell_of(c(value) - CORRIDOR_DEGREES, CORRIDOR_DEGREES), cell_of(c(value) + CORRIDOR_DEGREES, CORRIDOR_DEGREES)))
    boxes = ends.select("*", around("t_lat").alias("iy")).select("*", around("t_lon").alias("ix"))
    points = explode_waypoints(routes).select(
        *KEY, "seq", "lat", "lon", cell_of(c("lat"), CORRIDOR_DEGREES).alias("iy"),
        cell_of(c("lon"), CORRIDOR_DEGREES).alias("ix"),
    )
    points, boxes = split_hot_cells(points, boxes, ["iy", "ix"])
    inside = (F.abs(c("lat") - c("t_lat")) < CORRIDOR_DEGREES) & (F.abs(c("lon") - c("t_lon")) < CORRIDOR_DEGREES)
    near = points.join(boxes, ["iy", "ix", "salt"]).where(inside).groupBy(*KEY).agg(F.collect_set("seq").alias("near"))
    at = lambda seq: F.coalesce(F.array_contains("near", seq), F.lit(False))
    used = road_utilization(c("waypoints"), lambda g: at(g.seg) | at(g.seg + 1))
    return routes.join(near, KEY, "left").select(*KEY, used.alias("u")).select(*KEY, "u.*")


def summarize(sums: Column) -> Column:
    percent = F.when(sums.total > 0, sums.existing / sums.total * 100).otherwise(0.0)
    return F.struct(
        round_places(sums.total, 2).alias("total_distance_km"),
        round_places(sums.existing, 2).alias("existing_road_km"),
        round_places(sums.total - sums.existing, 2).alias("new_construction_km"),
        round_places(percent, 1).alias("utilization_percent"),
        round_places(percent * 0.8, 1).alias("cost_savings_percent"),
    )
