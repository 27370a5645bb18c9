"""Route plans along generated curves: two variants per request with every score and total."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadplan.functions import cost as C
from roadplan.functions import risk as R
from roadplan.functions.geometry import elevation_proxy, planar_km, round_places
from roadplan.operators.crossings import crossing_counts, estimate_count
from roadplan.operators.places import social_scores
from roadplan.operators.polyline import KEY, VARIANT_ORDER, curve_waypoints, elevations
from roadplan.operators.spatial import PLANAR_KM, Targets, attach_nearest
from roadplan.operators.survey import earthwork
from roadplan.operators.utilization import road_utilization

# Per variant its id, name, description, priority, length factor and difficulty base.
VARIANTS = {
    "shortest": ("route-1", "Shortest Route", "Minimizes distance and travel time", "Distance", 1.0, 50),
    "safest": ("route-2", "Safest Route", "Minimizes terrain and flood risks", "Safety", 1.25, 40),
}
RIVER_REACH_KM = 3.0
SEASONAL_DISCOUNT = 0.8


def curve_routes(requests: DataFrame) -> DataFrame:
    """Two rows per request, ``shortest`` and ``safest``, each with its waypoint array."""
    both = F.array(*[
        F.struct(F.lit(v).alias("variant"), curve_waypoints(v).alias("waypoints")) for v in VARIANTS
    ])
    return requests.select("*", F.inline(both))


def nearest_river_km(requests: DataFrame, river_vertices: DataFrame) -> DataFrame:
    """Distance from each request's midpoint to the nearest river vertex within 3 km, else null."""
    vertices = river_vertices.select(
        F.struct("river_id", "seq").alias("target_id"), F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon")
    )
    middle = requests.select(
        "route_id",
        ((F.col("start_lat") + F.col("end_lat")) / 2).alias("lat"),
        ((F.col("start_lon") + F.col("end_lon")) / 2).alias("lon"),
    )
    return attach_nearest(middle, Targets(vertices, PLANAR_KM, RIVER_REACH_KM)).select(
        "route_id", elevation_proxy(F.col("lat"), F.col("lon")).alias("mid_elevation"),
        F.col("distance").alias("river_km"),
    )


def site_risks(requests: DataFrame, river_vertices: DataFrame, rainfall: DataFrame | None = None) -> DataFrame:
    """Rainfall and flood score at each request's midpoint."""
    sites = requests.join(nearest_river_km(requests, river_vertices), "route_id")
    if rainfall is not None:
        per_district = rainfall.groupBy("district").agg(F.max("annual_mm").alias("annual_mm"))
        sites = sites.join(per_district, "district", "left")
        millimetres = F.coalesce("annual_mm", F.lit(R.DEFAULT_RAINFALL_MM))
    else:
        millimetres = F.lit(R.DEFAULT_RAINFALL_MM)
    return sites.select(
        "route_id",
        R.rainfall_risk(millimetres, F.col("mid_elevation")).alias("rainfall_risk"),
        R.flood_risk(F.col("mid_elevation"), F.col("river_km")).alias("flood_base_risk"),
    )


def by_variant(shortest: Column | int | str, safest: Column | int | str) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(F.col("variant") == "safest", lit(safest)).otherwise(lit(shortest))


def constant(position: int) -> Column:
    return by_variant(VARIANTS["shortest"][position], VARIANTS["safest"][position])


def pair_variants(routes: DataFrame, value: str) -> DataFrame:
    """Join each request's ``value`` of the safest variant with that of the shortest."""
    side = lambda v: routes.where(F.col("variant") == v).select("route_id", F.col(value).alias(f"{value}_{v}"))
    return side("shortest").join(side("safest"), "route_id")


def route_metrics(requests: DataFrame) -> DataFrame:
    """Everything about a variant that its own row tells: waypoints, length, gain, terrain, road use.

    Both variants' terrain scores are taken before the rows are split, so comparing them needs no join.
    """
    score = lambda v: R.terrain_risk(elevations(F.col(f"{v}_waypoints")))
    c = F.col
    drawn = requests.select("*", *[curve_waypoints(v).alias(f"{v}_waypoints") for v in VARIANTS])
    scored = drawn.select("*", score("shortest").alias("t_short"), score("safest").alias("t_safe"))
    both = F.array(
        F.struct(F.lit("shortest").alias("variant"), c("shortest_waypoints").alias("waypoints"),
                 c("t_short").alias("terrain_risk")),
        F.struct(F.lit("safest").alias("variant"), c("safest_waypoints").alias("waypoints"),
                 R.safest_terrain_curve(c("t_safe"), c("t_short")).alias("terrain_risk")),
    )
    straight = planar_km(c("start_lat"), c("start_lon"), c("end_lat"), c("end_lon"))
    return scored.select(*requests.columns, straight.alias("straight_km"), F.inline(both)).select(
        "*",
        R.elevation_gain(elevations(c("waypoints"))).alias("elevation_gain_m"),
        road_utilization(c("waypoints")).alias("road_utilization"),
    )


def plan_curve_routes(
    requests: DataFrame, river_vertices: DataFrame, river_segments: DataFrame, settlements: DataFrame,
    tourism: DataFrame, rainfall: DataFrame | None = None,
) -> DataFrame:
    """One row per request and variant with all scores, counts, costs and earthwork totals."""
    c = F.col
    base = route_metrics(requests)
    routes = base.select(*KEY, "waypoints")
    social = social_scores(routes, settlements, tourism)
    crossings = crossing_counts(routes, river_segments)
    known = (
        base.join(site_risks(requests, river_vertices, rainfall), "route_id")
        .join(crossings, KEY, "left").join(social, KEY, "left").join(earthwork(routes), KEY, "left")
    )
    scored = known.select(
        "*",
        F.coalesce("crossings", estimate_count(c("waypoints"))).cast("bigint").alias("bridges_required"),
        by_variant(c("flood_base_risk"), R.safest_flood_curve(c("flood_base_risk"))).alias("flood_risk"),
        by_variant(c("rainfall_risk") * 1.0, c("rainfall_risk") * SEASONAL_DISCOUNT).alias("seasonal"),
        (c("straight_km") * constant(4)).alias("km"),
    )
    return scored.select(
        *KEY, constant(0).alias("id"), constant(1).alias("name"), constant(2).alias("description"),
        constant(3).alias("priority"),
        round_places(F.col("km"), 2).alias("distance_km"), "elevation_gain_m",
        R.difficulty(c("terrain_risk"), constant(5)).alias("construction_difficulty"),
        C.construction_cost(
            c("road_utilization.new_construction_km"), c("road_utilization.existing_road_km"),
            c("terrain_risk"), c("bridges_required"),
        ).alias("estimated_cost"),
        C.curve_duration_days(c("km"), c("terrain_risk"), c("bridges_required")).alias("estimated_days"),
        R.overall_risk(c("terrain_risk"), c("flood_risk"), c("seasonal")).alias("risk_score"),
        "terrain_risk", "flood_risk", c("seasonal").cast("int").alias("seasonal_risk"), "bridges_required",
        "road_utilization.*",
        F.coalesce("settlements", F.lit(0).cast("bigint")).alias("settlements"),
        F.coalesce("social_impact_score", F.lit(0).cast("bigint")).alias("social_impact_score"),
        "total_waypoints", "total_length_m", "max_gradient_percent", "avg_gradient_percent",
        "total_cut_m3", "total_fill_m3", "balance_m3", "balance_status",
        (c("variant") == next(iter(VARIANT_ORDER))).alias("recommended"),
    )
