"""Routes along the road network: snapping, least-cost paths, route records and their enrichment."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadplan.functions import cost as C
from roadplan.functions import risk as R
from roadplan.functions.geometry import round_places
from roadplan.operators import network as N
from roadplan.operators import paths as P
from roadplan.operators.crossings import crossing_counts, estimate_count
from roadplan.operators.held_paths import held_paths
from roadplan.operators.places import social_scores
from roadplan.operators.polyline import (
    KEY, collapse_repeats, elevations, number_points, thin_points, waypoint_arrays,
)
from roadplan.operators.spatial import PLANAR_M, Targets, attach_nearest, checkpointed, split_hot_cells
from roadplan.operators.survey import earthwork
from roadplan.operators.two_sided import two_sided_paths
from roadplan.operators.utilization import road_utilization
from roadplan.plans.curve import site_risks

# Snapping radius in metres and the two criteria routed for every request.
SNAP_M = 2000.0
CRITERIA = ["shortest", "safest"]
NAMES = {"shortest": "Shortest Route", "safest": "Safest Route", "budget": "Budget Route", "social": "Social Route"}


@dataclass(frozen=True)
class NetworkRoutes:
    """``status`` per request, ``segments`` and ``waypoints`` per (request, criterion) with a path."""

    status: DataFrame
    costs: DataFrame
    segments: DataFrame
    waypoints: DataFrame


def node_targets(nodes: DataFrame, radius_m: float = SNAP_M) -> Targets:
    targets = nodes.select(
        F.col("node_id").alias("target_id"), F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon")
    )
    return Targets(targets, PLANAR_M, radius_m)


def snapped_ends(requests: DataFrame, targets: Targets) -> DataFrame:
    """Nearest node of each request's start and end, null where none is in reach."""
    ends = F.inline(F.array(
        F.struct(F.lit("start").alias("end"), F.col("start_lat").alias("lat"), F.col("start_lon").alias("lon")),
        F.struct(F.lit("end").alias("end"), F.col("end_lat").alias("lat"), F.col("end_lon").alias("lon")),
    ))
    snapped = attach_nearest(requests.select("route_id", ends), targets)
    side = lambda which, value: F.max(F.when(F.col("end") == which, F.col(value)))
    return snapped.groupBy("route_id").agg(
        side("start", "target_id").alias("start_node"), side("end", "target_id").alias("end_node"),
        side("start", "distance").alias("start_snap_m"), side("end", "distance").alias("end_snap_m"),
    )


def route_status(snapped: DataFrame, reached: DataFrame, unfinished: DataFrame) -> DataFrame:
    """Why a request has no network route, or ``OK``.

    ``reached`` lists (source, target) pairs with a path, ``unfinished`` those of which a search was cut short.
    """
    known = reached.select("source", "target", F.lit(True).alias("found"), F.lit(False).alias("cut")).unionByName(
        unfinished.select("source", "target", F.lit(False).alias("found"), F.lit(True).alias("cut")))
    pairs = known.groupBy(F.col("source").alias("start_node"), F.col("target").alias("end_node")).agg(
        F.max("found").alias("found"), F.max("cut").alias("cut"))
    status = (
        F.when(F.col("start_node").isNull(), "NO_SNAP_POINT_START")
        .when(F.col("end_node").isNull(), "NO_SNAP_POINT_END")
        .when(F.col("start_node") == F.col("end_node"), "SAME_NODE")
        .when(F.col("cut"), "UNFINISHED")
        .when(F.col("found").isNull(), "NO_PATH_EXISTS")
        .otherwise("OK")
    )
    return snapped.join(pairs, ["start_node", "end_node"], "left").select(
        "route_id", "start_node", "end_node", status.alias("status")
    )


def search_paths(
    searches: DataFrame, nodes: DataFrame, edges: DataFrame, criteria: list[str], factors: dict[str, float],
    max_rounds: int | None, both_ends: bool,
) -> P.PathTable:
    """By workers that hold the network, if it fits; a larger one, or searches with a limit of rounds, by rounds of joins."""
    table = held_paths(searches, nodes, edges, criteria, factors, both_ends) if max_rounds is None else None
    if table is not None:
        return table
    search = two_sided_paths if both_ends else P.least_cost_paths
    return search(searches, nodes, edges, criteria, max_rounds, factors)


def find_routes(
    requests: DataFrame, nodes: DataFrame, edges: DataFrame, criteria: list[str] = CRITERIA,
    contract: bool = True, max_rounds: int | None = None, both_ends: bool = True,
) -> NetworkRoutes:
    """Snap, search and describe the paths of all requests at once.

    ``edges`` carry attributes and one cost column per criterion. Requests between the same nodes share
    one search. With ``contract`` chains of nodes without a junction are searched as single edges. A criterion may be
    any column of non-negative costs. Searches go from both ends, or with ``both_ends`` off from the source alone, with the
    same result. With ``max_rounds`` the status of requests whose search was cut short is
    ``UNFINISHED``, and such a search gives no route.
    """
    snapped = checkpointed(snapped_ends(requests, node_targets(nodes)))
    both = snapped.where(F.col("start_node") != F.col("end_node"))
    searches = both.select(
        F.explode(F.array(*[F.lit(x) for x in criteria])).alias("criterion"),
        F.col("start_node").alias("source"), F.col("end_node").alias("target"),
    ).distinct()
    factors = P.least_factors(edges, criteria, P.LEAST_FACTOR)
    if contract:
        stops = searches.select(F.explode(F.array("source", "target")).alias("node_id")).distinct()
        members = P.chain_members(edges, stops)
        table = search_paths(
            searches, nodes, checkpointed(P.contract(edges, members, criteria)), criteria, factors, max_rounds, both_ends)
        steps = P.expand(P.path_edges(table), members)
    else:
        table = search_paths(searches, nodes, edges, criteria, factors, max_rounds, both_ends)
        steps = P.path_edges(table).withColumn("rank", F.lit(0))
    reached = P.arrivals(table)
    per_request = both.select("route_id", F.col("start_node").alias("source"), F.col("end_node").alias("target"))
    askers, answers = split_hot_cells(per_request, steps, ["source", "target"])
    segments = (
        askers.join(answers, ["source", "target", "salt"]).withColumnRenamed("criterion", "variant")
        .join(edges, "edge_id")
        .select(*KEY, "hop", "rank", "edge_id", "name", "highway_type", "distance_m", "lat1", "lon1", "lat2", "lon2")
    )
    costs = per_request.join(reached, ["source", "target"]).select(
        "route_id", F.col("criterion").alias("variant"), "cost", "hops"
    )
    return NetworkRoutes(route_status(snapped, reached, table.open_searches), costs, segments, path_waypoints(segments))


def path_waypoints(segments: DataFrame, thin: bool = True) -> DataFrame:
    """Both ends of every segment in path order, repeats dropped, as arrays; thinned to 25 unless told otherwise."""
    ends = F.inline(F.array(
        F.struct(F.lit(0).alias("side"), F.col("lat1").alias("lat"), F.col("lon1").alias("lon")),
        F.struct(F.lit(1).alias("side"), F.col("lat2").alias("lat"), F.col("lon2").alias("lon")),
    ))
    points = segments.select(*KEY, "hop", "rank", ends)
    order = ["hop", "rank", "side"]
    points = collapse_repeats(points, *order)
    return waypoint_arrays(thin_points(points, *order) if thin else number_points(points, *order))


def enrich(
    routes: DataFrame, requests: DataFrame, river_vertices: DataFrame, river_segments: DataFrame,
    settlements: DataFrame, tourism: DataFrame, rainfall: DataFrame | None = None,
    survey: list[str] = ["total_waypoints", "total_cut_m3", "total_fill_m3", "balance_status"],
) -> DataFrame:
    """Scores, counts and earthwork for routes that already have waypoints, length, stats and cost.

    ``routes`` has the route key, ``waypoints``, ``total_distance_km``, ``estimated_cost`` and any other columns,
    which are kept. Risks are taken at the request's midpoint. ``survey`` names the earthwork columns to keep.
    """
    c = F.col
    shape = routes.select(*KEY, "waypoints")
    social = social_scores(shape, settlements, tourism)
    known = (
        routes.join(site_risks(requests, river_vertices, rainfall), "route_id")
        .join(crossing_counts(shape, river_segments), KEY, "left").join(social, KEY, "left")
        .join(earthwork(shape), KEY, "left")
    )
    levels = elevations(c("waypoints"))
    terrain, safest = R.terrain_risk(levels), c("variant") == "safest"
    scored = known.select(
        "*",
        F.when(safest, R.safest_terrain_network(terrain)).otherwise(terrain).alias("terrain_risk"),
        F.when(safest, R.safest_flood_network(c("flood_base_risk"))).otherwise(c("flood_base_risk")).alias("flood_risk"),
        R.elevation_gain(levels).alias("elevation_gain_m"),
        F.coalesce("crossings", estimate_count(c("waypoints"))).cast("bigint").alias("bridges_required"),
        C.network_duration_days(c("total_distance_km")).alias("estimated_days"),
        road_utilization(c("waypoints")).alias("road_utilization"),
    )
    zero = F.lit(0).cast("bigint")
    return scored.select(
        *[x for x in routes.columns if x != "waypoints"],
        F.size("waypoints").alias("waypoint_count"), "elevation_gain_m", "estimated_days",
        "terrain_risk", "flood_risk", "rainfall_risk",
        R.overall_risk(c("terrain_risk"), c("flood_risk"), c("rainfall_risk")).alias("risk_score"),
        "bridges_required", F.coalesce("settlements", zero).alias("settlements"),
        F.coalesce("social_impact_score", zero).alias("social_impact_score"),
        c("road_utilization.utilization_percent").alias("corridor_percent"), *survey,
    )


def network_route_records(found: NetworkRoutes, edges: DataFrame) -> DataFrame:
    """One row per found route: name, waypoints, length, construction stats and cost."""
    stats = N.construction_stats(N.classified_segments(found.segments, edges), *KEY)
    names = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    return found.waypoints.join(stats, KEY).select(
        *KEY, names[F.col("variant")].alias("name"), "waypoints", "total_distance_km",
        "new_construction_km", "upgrade_existing_km", "utilization_percent", "cost_savings_percent",
        round_places(F.col("estimated_cost"), 2).alias("estimated_cost"),
    )
