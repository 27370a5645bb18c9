"""Named queries over the derived geography, one per operator or report."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadplan import fixtures as X
from roadplan.functions import cost as C
from roadplan.functions import risk as R
from roadplan.functions import text as T
from roadplan.functions.geometry import elevation_proxy, haversine_m, planar_km, round_places
from roadplan.operators import crossings as K
from roadplan.operators import network as N
from roadplan.operators import places as P
from roadplan.operators import survey as S
from roadplan.operators.polyline import KEY, elevations, explode_waypoints, keep_when_thinned
from roadplan.operators.utilization import corridor_utilization, road_utilization
from roadplan.operators.spatial import checkpointed, fresh_folder
from roadplan.operators.simplify import simplify_lines
from roadplan.plans import curve
from roadplan.plans import fallback as B
from roadplan.plans import network_routes as G
from roadplan.plans.pipeline import Surroundings, plan_routes
from roadplan.sinks import documents as D
from roadplan.sinks import snapshot
from roadplan.sources import defaults, files, requests as intake
from roadplan.streaming.requests import request_stream, start_planning

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def query(fn: Callable[[SparkSession, str], DataFrame]):
    """Register; Python workers are told where this package is, whatever folder the session was started in."""
    @functools.wraps(fn)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
        if ROOT not in paths:
            spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
        return fn(spark, sf)

    QUERIES[fn.__name__] = run
    return run


STORED: dict[tuple, object] = {}


def stored(fn: Callable):
    """Once per session and folder: what many queries build on is computed and written by the first that asks for it."""
    def once(spark: SparkSession, sf: str):
        key = (spark.sparkContext.applicationId, fn.__name__, sf)
        if key not in STORED:
            STORED[key] = fn(spark, sf)
        return STORED[key]

    return once


def c(name: str):
    return F.col(name)


def spread_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Requests are few bytes but fan out into thousands of stations each, so they are spread first.

    Keying by ``route_id`` lets every later aggregation per route run where the rows already are.
    """
    return X.requests(spark, sf).repartition(partitions(spark), "route_id")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def routes(spark: SparkSession, sf: str) -> DataFrame:
    return curve.curve_routes(spread_requests(spark, sf)).select(*KEY, "waypoints")


def rivers(spark: SparkSession, sf: str) -> DataFrame:
    return K.river_segments(X.river_vertices(spark, sf))


@query
def curve_waypoints(spark, sf):
    return explode_waypoints(routes(spark, sf))


@query
def terrain_risk(spark, sf):
    return curve.route_metrics(spread_requests(spark, sf)).select(*KEY, "terrain_risk")


@query
def elevation_gain(spark, sf):
    return routes(spark, sf).select(*KEY, R.elevation_gain(elevations(c("waypoints"))).alias("elevation_gain_m"))


@query
def variant_pairs(spark, sf):
    scored = routes(spark, sf).select(*KEY, R.terrain_risk(elevations(c("waypoints"))).alias("terrain"))
    return curve.pair_variants(scored, "terrain").select(
        "*", R.safest_terrain_curve(c("terrain_safest"), c("terrain_shortest")).alias("terrain_adjusted")
    )


@query
def request_distance(spark, sf):
    ends = [c(x) for x in ("start_lat", "start_lon", "end_lat", "end_lon")]
    return X.requests(spark, sf).select(
        "route_id", round_places(haversine_m(*ends), 3).alias("haversine_m"),
        round_places(planar_km(*ends), 6).alias("planar_km"),
    )


@query
def flood_band(spark, sf):
    elevation = elevation_proxy(c("lat"), c("lon"))
    return X.nodes(spark, sf).select(
        "node_id", elevation.alias("elevation"), R.flood_base(elevation).alias("flood_base")
    )


@query
def site_risks(spark, sf):
    return curve.site_risks(spread_requests(spark, sf), X.river_vertices(spark, sf), X.rainfall(spark, sf))


@query
def nearest_river(spark, sf):
    near = curve.nearest_river_km(spread_requests(spark, sf), X.river_vertices(spark, sf))
    return near.select("route_id", "mid_elevation", round_places(c("river_km"), 6).alias("river_km"))


@query
def raw_crossings(spark, sf):
    return K.raw_crossings(routes(spark, sf), rivers(spark, sf))


@query
def river_crossings(spark, sf):
    return K.river_crossings(routes(spark, sf), rivers(spark, sf)).drop("bridge_required")


@query
def settlements_near(spark, sf):
    near = P.closest_settlements(routes(spark, sf), X.settlements(spark, sf))
    return near.drop("wp_seq", "feature_seq")


@query
def tourism_near(spark, sf):
    return P.top_tourism(P.tourism_near(routes(spark, sf), X.tourism(spark, sf)), 3).drop("wp_seq", "feature_seq")


@query
def social_score(spark, sf):
    return P.social_scores(routes(spark, sf), X.settlements(spark, sf), X.tourism(spark, sf))


@query
def road_utilization_(spark, sf):
    return routes(spark, sf).select(*KEY, road_utilization(c("waypoints")).alias("u")).select(*KEY, "u.*")


QUERIES["road_utilization"] = QUERIES.pop("road_utilization_")


@query
def corridor_table(spark, sf):
    """Road utilization against the table of major routes."""
    return corridor_utilization(routes(spark, sf), defaults.major_routes(spark))


@query
def survey_points(spark, sf):
    return S.head_stations(routes(spark, sf), 10)


@query
def survey_classes(spark, sf):
    """All stations of all routes, summed up by class."""
    return S.station_table(S.survey_points(routes(spark, sf))).groupBy(*KEY, "cut_fill_type").agg(
        F.count("*").alias("stations"), F.sum("chainage_m").alias("chainage_sum"),
        F.sum("ground_elevation_m").alias("ground_sum"), F.sum("design_elevation_m").alias("design_sum"),
        round_places(F.sum("cut_fill_depth_m"), 1).alias("depth_sum"),
        round_places(F.sum("gradient_percent"), 1).alias("gradient_sum"),
    )


@query
def earthwork(spark, sf):
    return S.earthwork(routes(spark, sf)).drop("road_width_m")


@query
def field_instructions(spark, sf):
    return S.field_instructions(S.earthwork(routes(spark, sf)))


def plan(spark: SparkSession, sf: str) -> DataFrame:
    vertices = X.river_vertices(spark, sf)
    return curve.plan_curve_routes(
        spread_requests(spark, sf), vertices, K.river_segments(vertices), X.settlements(spark, sf),
        X.tourism(spark, sf), X.rainfall(spark, sf),
    )


QUERIES["route_plan"] = plan


BBOX = (29.0, 78.0, 31.0, 80.5)


@stored
def vertices(spark: SparkSession, sf: str) -> DataFrame:
    return N.locate(X.way_refs(spark, sf), X.nodes(spark, sf))


@stored
def major_ways(spark: SparkSession, sf: str) -> DataFrame:
    return checkpointed(N.filtered_ways(X.ways(spark, sf), vertices(spark, sf)))


def all_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of ways of every class."""
    return N.directed_edges(vertices(spark, sf), N.tagged_ways(X.ways(spark, sf)))


@stored
def network(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the major-road network, stored once because later steps read them many times."""
    points, ways = vertices(spark, sf), major_ways(spark, sf)
    kept = points.join(ways.select("way_id"), "way_id", "left_semi")
    return checkpointed(N.distinct_nodes(kept)), checkpointed(N.edge_costs(N.directed_edges(points, ways)))


@query
def ways_filtered(spark, sf):
    return N.filtered_ways(X.ways(spark, sf), vertices(spark, sf), bbox=BBOX)


@query
def quality_issues(spark, sf):
    refs, nodes = X.way_refs(spark, sf), X.nodes(spark, sf)
    return N.quality_issues(X.ways(spark, sf), major_ways(spark, sf), N.unlocated_ways(refs, nodes))


@query
def first_issues(spark, sf):
    return N.first_issues(quality_issues(spark, sf))


@query
def network_nodes(spark, sf):
    kept = vertices(spark, sf).join(major_ways(spark, sf).select("way_id"), "way_id", "left_semi")
    return N.distinct_nodes(kept)


@query
def edges(spark, sf):
    rows = N.directed_edges(vertices(spark, sf), major_ways(spark, sf))
    return rows.withColumn("distance_m", round_places(c("distance_m"), 3)).drop("condition")


@query
def way_length(spark, sf):
    lengths = N.way_lengths(N.directed_edges(vertices(spark, sf), major_ways(spark, sf)))
    return lengths.withColumn("distance_m", round_places(c("distance_m"), 3))


@query
def adjacency(spark, sf):
    return N.adjacency(N.directed_edges(vertices(spark, sf), major_ways(spark, sf)))


@query
def adjacency_lists(spark, sf):
    """Every node's edges out and in, lists as texts."""
    lists = N.adjacency_lists(N.directed_edges(vertices(spark, sf), major_ways(spark, sf)))
    text = lambda side: F.array_join(F.transform(side, lambda x: F.concat_ws(">", x["edge_id"], x["node"])), ",").alias(side)
    return lists.select("node_id", "part", text("out"), text("into"))


@query
def network_stats(spark, sf):
    ways = major_ways(spark, sf)
    nodes = N.distinct_nodes(vertices(spark, sf).join(ways.select("way_id"), "way_id", "left_semi"))
    rows = N.directed_edges(vertices(spark, sf), ways)
    return N.network_stats(ways, nodes, rows, N.quality_issues(X.ways(spark, sf), ways))


@query
def edge_costs(spark, sf):
    costs = N.edge_costs(all_edges(spark, sf))
    return costs.select("edge_id", *[round_places(c(x), 3).alias(x) for x in ("shortest", "safest", "budget")])


@query
def social_edges(spark, sf):
    near = N.near_settlement(all_edges(spark, sf), X.settlements(spark, sf))
    return N.edge_costs(near).select("edge_id", "near_settlement", round_places(c("social"), 3).alias("social"))


@query
def segment_class(spark, sf):
    """Edges of all classes as segments of their way, against a network that lacks every way divisible by seven."""
    segments = all_edges(spark, sf)
    known = segments.where(c("way_id") % 7 != 0)
    rows = N.classified_segments(segments.select("way_id", "edge_id", "distance_m"), known)
    return rows.select("edge_id", "construction_type", "cost_factor")


@query
def construction_stats(spark, sf):
    segments = all_edges(spark, sf)
    known = segments.where(c("way_id") % 7 != 0)
    rows = N.classified_segments(segments.select("way_id", "edge_id", "distance_m"), known)
    stats = N.construction_stats(rows, "way_id")
    return stats.select(
        "way_id", round_places(c("total_distance_km"), 3).alias("total_distance_km"), "new_construction_km",
        "upgrade_existing_km", "utilization_percent", "cost_savings_percent",
        round_places(c("estimated_cost"), 0).alias("estimated_cost"),
    )


@query
def snap(spark, sf):
    snapped = G.snapped_ends(spread_requests(spark, sf), G.node_targets(X.nodes(spark, sf)))
    return snapped.select(
        "route_id", "start_node", "end_node", round_places(c("start_snap_m"), 3).alias("start_snap_m"),
        round_places(c("end_snap_m"), 3).alias("end_snap_m"),
    )


@stored
def found_routes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, G.NetworkRoutes]:
    nodes, roads = network(spark, sf)
    return nodes, roads, G.find_routes(spread_requests(spark, sf), nodes, roads)


@query
def route_status(spark, sf):
    return found_routes(spark, sf)[2].status


@query
def path_costs(spark, sf):
    costs = found_routes(spark, sf)[2].costs
    return costs.select(*KEY, round_places(c("cost"), 3).alias("cost"))


def searched(spark: SparkSession, sf: str, roads: DataFrame, criteria: list[str], **options) -> DataFrame:
    nodes = network(spark, sf)[0]
    found = G.find_routes(spread_requests(spark, sf), nodes, roads, criteria, **options)
    return found.costs.select(*KEY, round_places(c("cost"), 3).alias("cost"))


@query
def budget_paths(spark, sf):
    return searched(spark, sf, network(spark, sf)[1], ["budget"])


@query
def social_paths(spark, sf):
    roads = network(spark, sf)[1].drop("shortest", "safest", "budget")
    return searched(spark, sf, checkpointed(N.edge_costs(N.near_settlement(roads, X.settlements(spark, sf)))), ["social"])


@query
def custom_cost_paths(spark, sf):
    """Hours on the road, a criterion of the caller's own."""
    km = c("distance_m") / 1000
    hours = F.when(c("highway_type").isin("primary", "trunk"), km / 60).when(c("highway_type") == "secondary", km / 45)
    roads = network(spark, sf)[1].withColumn("hours", hours.otherwise(km / 25))
    return searched(spark, sf, roads, ["hours"])


@query
def contracted_paths(spark, sf):
    """Roads open in both directions, chains searched as single edges."""
    return searched(spark, sf, N.bidirectional(network(spark, sf)[1]), ["shortest"], contract=True)


@query
def uncontracted_paths(spark, sf):
    """Searched from the source alone, over the roads as they are."""
    return searched(spark, sf, network(spark, sf)[1], ["shortest", "safest"], contract=False, both_ends=False)


@query
def two_sided_paths(spark, sf):
    """Edges of every path, searched from both ends over the roads as they are."""
    nodes, roads = network(spark, sf)
    found = G.find_routes(spread_requests(spark, sf), nodes, roads, ["shortest", "safest"], contract=False)
    return found.segments.select(*KEY, "hop", "edge_id")


@query
def route_from_path(spark, sf):
    _, roads, found = found_routes(spark, sf)
    records = G.network_route_records(found, roads)
    return records.select(
        *KEY, "name", F.size("waypoints").alias("waypoint_count"),
        round_places(c("total_distance_km"), 6).alias("total_distance_km"),
        "new_construction_km", "upgrade_existing_km", "utilization_percent", "cost_savings_percent",
        round_places(c("estimated_cost"), 0).alias("estimated_cost"),
    )


@query
def network_plan(spark, sf):
    _, roads, found = found_routes(spark, sf)
    river = X.river_vertices(spark, sf)
    return G.enrich(
        checkpointed(G.network_route_records(found, roads)), spread_requests(spark, sf), river,
        K.river_segments(river), X.settlements(spark, sf), X.tourism(spark, sf), X.rainfall(spark, sf),
    ).withColumn("total_distance_km", round_places(c("total_distance_km"), 6))


@query
def straight_samples(spark, sf):
    targets = G.node_targets(X.nodes(spark, sf), B.SAMPLE_SNAP_M)
    rows = B.snapped_samples(spread_requests(spark, sf), targets)
    return rows.withColumn("lat", round_places(c("lat"), 9)).withColumn("lon", round_places(c("lon"), 9))


@query
def hybrid_route(spark, sf):
    targets = G.node_targets(X.nodes(spark, sf), B.SAMPLE_SNAP_M)
    return B.hybrid_routes(spread_requests(spark, sf), targets).select(
        *KEY, "name", round_places(c("total_distance_km"), 6).alias("total_distance_km"), "new_construction_km",
        round_places(c("estimated_cost"), 0).alias("estimated_cost"),
    )


@query
def routing_method(spark, sf):
    nodes, _, found = found_routes(spark, sf)
    requests = spread_requests(spark, sf)
    routes = B.routed(requests, found.status, found.waypoints, G.node_targets(nodes, B.SAMPLE_SNAP_M))
    return routes.select(*KEY, "routing_method")


@query
def planned_routes(spark, sf):
    """Network, hybrid and curve routes of all requests with the same columns."""
    around = Surroundings(
        X.river_vertices(spark, sf), X.settlements(spark, sf), X.tourism(spark, sf), X.rainfall(spark, sf))
    plans = plan_routes(spread_requests(spark, sf), *network(spark, sf), around)
    return plans.withColumns({
        "distance_km": round_places(c("distance_km"), 6), "estimated_cost": round_places(c("estimated_cost"), 0)})


@query
def thinned_rivers(spark, sf):
    """River lines thinned to 25 vertices. The vertex number is known, so only the counts are aggregated."""
    rows = X.river_vertices(spark, sf)
    counts = rows.groupBy("river_id").agg(F.count("*").alias("n"))
    kept = rows.join(counts, "river_id").where(keep_when_thinned(c("seq"), c("n")))
    return kept.select("river_id", "seq", "lat", "lon")


@query
def simplified_rivers(spark, sf):
    rows = X.river_vertices(spark, sf).withColumnRenamed("river_id", "line_id")
    return simplify_lines(rows, 0.02).select("line_id", "seq")


def scored_curves(spark: SparkSession, sf: str) -> DataFrame:
    """Curves with the figures an export prints, short of the joins a full plan needs."""
    metrics = curve.route_metrics(spread_requests(spark, sf))
    km = c("straight_km") * curve.constant(4)
    return metrics.select(
        *KEY, "waypoints", curve.constant(1).alias("name"), curve.constant(2).alias("description"),
        round_places(km, 2).alias("distance_km"), "elevation_gain_m",
        C.construction_cost(
            c("road_utilization.new_construction_km"), c("road_utilization.existing_road_km"),
            c("terrain_risk"), F.lit(0),
        ).alias("estimated_cost"),
        c("terrain_risk").alias("risk_score"), "context",
    )


@query
def survey_documents(spark, sf):
    """Digest of each surveyed line's KML and GPX, and what its GeoJSON holds."""
    r = routes(spark, sf)
    documents = D.survey_documents(r, S.earthwork(r), curve.constant(1))
    return documents.select(
        *KEY, F.md5("kml").alias("kml_md5"), F.md5("gpx").alias("gpx_md5"),
        F.json_array_length(F.get_json_object("geojson", "$.features[0].geometry.coordinates")).alias("vertices"),
        F.get_json_object("geojson", "$.features[0].properties.total_cut_volume_m3").cast("bigint").alias("cut"),
        F.get_json_object("geojson", "$.features[0].properties.waypoints[0].lat").cast("double").alias("first_lat"),
    )


@query
def waypoint_documents(spark, sf):
    return D.waypoint_documents(scored_curves(spark, sf))


@query
def road_features(spark, sf):
    rows = N.directed_edges(vertices(spark, sf), major_ways(spark, sf))
    return D.road_features(rows.withColumn("distance_m", round_places(c("distance_m"), 3)), 500)


@query
def road_collection(spark, sf):
    return D.road_collection(road_features(spark, sf))


@query
def layer_config(spark, sf):
    return D.layer_config(scored_curves(spark, sf).select(*KEY, "name"))


@query
def explanations(spark, sf):
    rows = scored_curves(spark, sf)
    return rows.select(
        *KEY, T.explanation_prompt(
            c("name"), c("distance_km"), c("elevation_gain_m"), c("risk_score"), F.lit(None).cast("int"),
            F.lit(None).cast("int"), c("context"),
        ).alias("prompt"), T.fallback_explanation(c("name")).alias("fallback"),
    )


@query
def display_text(spark, sf):
    """Bands and texts of the route cards, over the earthwork and scores of every route."""
    totals = S.earthwork(routes(spark, sf)).select(*KEY, "total_cut_m3", "total_fill_m3", "balance_status")
    rows = scored_curves(spark, sf).join(totals, KEY)
    low = F.greatest(c("risk_score") - 60, F.lit(0))
    return rows.select(
        *KEY, R.risk_band(c("risk_score")).alias("band"),
        R.displayed_risk(low, F.lit(None).cast("int")).alias("shown_risk"),
        T.cost_text(c("estimated_cost")).alias("cost"), T.volume_text(c("total_cut_m3")).alias("cut"),
        T.volume_text(c("total_fill_m3")).alias("fill"), S.E.status_title(c("balance_status")).alias("status"),
    )


@query
def bridge_estimates(spark, sf):
    return routes(spark, sf).select(*KEY, K.estimate_count(c("waypoints")).alias("bridges"))


@query
def request_intake(spark, sf):
    """Customers as JSON events: every third wrapped in a body text, some fields missing or unusable."""
    key = c("route_id")
    lat = F.when(key % 11 == 0, F.lit('"north"')).otherwise(c("start_lat").cast("string"))
    start = F.when(key % 7 == 0, F.lit("{}")).otherwise(
        F.concat(F.lit('{"lat":'), lat, F.lit(',"lon":"'), c("start_lon").cast("string"), F.lit('"}'))
    )
    body = F.concat(F.lit('{"start":'), start, F.lit(',"context":"'), c("context"), F.lit('"}'))
    wrapped = F.to_json(F.struct(body.alias("body")))
    events = X.requests(spark, sf).select("route_id", F.when(key % 3 == 0, wrapped).otherwise(body).alias("event"))
    return intake.parse_requests(events).drop("event")


@query
def region_guard(spark, sf):
    moved = X.requests(spark, sf).select(
        "route_id", (c("start_lat") + 0.5).alias("start_lat"), c("start_lon"), (c("end_lat") - 0.5).alias("end_lat"),
        "end_lon",
    )
    return intake.guard_requests(moved).select("route_id", "inside")


@query
def rainfall_lines(spark, sf):
    region = X.table(spark, sf, "region")
    lines = region.select(
        F.concat(F.lit("IN,"), c("r_name"), F.lit(","), F.when(c("r_regionkey") % 2 == 0, F.lit("n/a")).otherwise(
            (900 + 300 * c("r_regionkey")).cast("string"))).alias("value"),
        c("r_regionkey").alias("line_no"),
    )
    return files.rainfall_lines(lines, ["Africa", "America", "Asia", "Europe", "MIDDLE EAST"])


def feature_file(spark: SparkSession, sf: str) -> DataFrame:
    """Rivers and settlements written as GeoJSON features, one per line, and read back."""
    pair = lambda: F.array("lon", "lat")
    line = F.transform(F.array_sort(F.collect_list(F.struct("seq", pair().alias("at")))), lambda x: x["at"])
    feature = lambda kind, at, *properties: F.to_json(F.struct(
        F.lit("Feature").alias("type"), F.struct(F.lit(kind).alias("type"), at.alias("coordinates")).alias("geometry"),
        F.struct(*properties).alias("properties"))).alias("value")
    drawn = X.river_vertices(spark, sf).groupBy("river_id", "name").agg(line.alias("line"))
    lines = drawn.select(
        F.lit(0).alias("kind"), c("river_id").alias("id"),
        feature("LineString", c("line"), "name", F.lit("river").alias("waterway"))).unionByName(X.settlements(spark, sf).select(
            F.lit(1).alias("kind"), c("feature_seq").alias("id"), feature("Point", pair(), "name", "place", "population")))
    path = fresh_folder(spark)
    lines.repartitionByRange(4, "kind", "id").sortWithinPartitions("kind", "id").select("value").write.text(path)
    return files.read_features(spark, path, one_per_line=True)


@query
def river_features(spark, sf):
    return files.line_vertices(feature_file(spark, sf))


@query
def settlement_features(spark, sf):
    return files.point_places(feature_file(spark, sf))


@query
def source_choice(spark, sf):
    """Settlements from a file that is whole, from one broken at its last row, and from none: which source is used."""
    path, count = fresh_folder(spark), lambda df: df.agg(F.count("*").alias("places"))
    lines = X.settlements(spark, sf).select("feature_seq", F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"),
        F.struct("name", "place").alias("properties"))).alias("value"))
    lines.select("value").write.text(f"{path}/whole")
    last = lines.agg(F.max("feature_seq")).first()[0]
    broken = lines.withColumn("value", F.when(c("feature_seq") == last, F.substring("value", 1, 40)).otherwise(c("value")))
    broken.coalesce(1).sortWithinPartitions("feature_seq").select("value").write.text(f"{path}/broken")
    rows = None
    for name in ("whole", "broken", "missing"):
        found, own = files.choose_source(
            lambda name=name: files.point_places(files.read_features(spark, f"{path}/{name}", one_per_line=True)),
            defaults.settlements(spark))
        row = count(found).select(F.lit(name).alias("source"), F.lit("file" if own else "default").alias("used"), "places")
        rows = row if rows is None else rows.unionByName(row)
    return rows


@query
def builtin_tourism(spark, sf):
    """Tourism spots of the built-in table near the routes, the best three of each."""
    near = P.top_tourism(P.tourism_near(routes(spark, sf), defaults.tourism_spots(spark)), 3)
    return near.select(*KEY, "rank", "name", "score", "distance_from_route_km")


@query
def osm_ways(spark, sf):
    """Ways and nodes written as OSM XML and read back, as way vertices with their tags."""
    path = fresh_folder(spark)
    nodes = X.nodes(spark, sf).select(
        c("node_id").alias("_id"), c("lat").alias("_lat"), c("lon").alias("_lon"), F.lit("yes").alias("visible"))
    nodes.write.format("xml").option("rootTag", "osm").option("rowTag", "node").save(f"{path}/nodes")
    refs = F.transform(F.array_sort(F.collect_list(F.struct("pos", "ref"))), lambda x: F.struct(x["ref"].alias("_ref")))
    tags = F.transform(F.map_entries("tags"), lambda x: F.struct(x["key"].alias("_k"), x["value"].alias("_v")))
    ways = X.way_refs(spark, sf).groupBy("way_id").agg(refs.alias("nd")).join(X.ways(spark, sf), "way_id").select(
        c("way_id").alias("_id"), "nd", tags.alias("tag"))
    ways.write.format("xml").option("rootTag", "osm").option("rowTag", "way").save(f"{path}/ways")
    tagged, members, located = files.read_osm_ways(spark, f"{path}/*")
    return members.join(tagged, "way_id").join(located, c("ref") == c("node_id")).select(
        "way_id", "pos", "ref", "lat", "lon", *[c("tags")[k].alias(k) for k in ("highway", "surface", "name")])


@query
def network_snapshot(spark, sf):
    """The network written as a snapshot and read back: edges and metres by class, with the metadata."""
    path, source = fresh_folder(spark), f"{sf}/orders.parquet"
    nodes, roads = network(spark, sf)
    ways = major_ways(spark, sf)
    stats = N.network_stats(ways, nodes, roads, N.quality_issues(X.ways(spark, sf), ways))
    snapshot.write_snapshot(nodes, roads, stats, path, source, BBOX)
    nodes, roads, metadata = snapshot.read_snapshot(spark, path)
    classes = roads.groupBy("highway_type").agg(
        F.count("*").alias("edges"), round_places(F.sum("distance_m"), 1).alias("distance_m"))
    return classes.join(metadata, F.array_contains("highway_types", c("highway_type"))).select(
        "highway_type", "edges", "distance_m", "total_roads_parsed", "total_nodes", "total_edges",
        "data_quality_issues", F.lit(snapshot.is_valid(metadata, source)).alias("valid"))


@query
def streamed_requests(spark, sf):
    """Requests as a stream of JSON files, some unusable or outside the area: waypoints per route, or why it has none."""
    path, key = fresh_folder(spark), c("route_id")
    end = lambda side, lat: F.struct(lat.alias("lat"), c(f"{side}_lon").alias("lon")).alias(side)
    moved = F.when(key % 13 == 0, c("start_lat") + 3.5).otherwise(c("start_lat"))
    good = F.to_json(F.struct(end("start", moved), end("end", c("end_lat")), "context"))
    event = F.when(key % 11 == 0, F.lit("not JSON")).otherwise(good)
    X.requests(spark, sf).select("route_id", event.alias("event")).write.json(f"{path}/in")
    plan = lambda batch: curve.curve_routes(batch).select(*KEY, F.size("waypoints").alias("waypoints"))
    start_planning(
        request_stream(spark, f"{path}/in"), plan, f"{path}/out", f"{path}/progress", availableNow=True,
    ).awaitTermination()
    plans, rejects = spark.read.parquet(f"{path}/out/plans"), spark.read.parquet(f"{path}/out/rejects")
    return plans.select(*KEY, "waypoints", F.lit(None).cast("string").alias("reason")).unionByName(
        rejects.select("route_id", "reason"), allowMissingColumns=True)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    r, river = routes(spark, sf), X.river_vertices(spark, sf)
    segments = K.river_segments(river)
    return D.response_documents(
        checkpointed(plan(spark, sf)), r, K.river_crossings(r, segments),
        P.closest_settlements(r, X.settlements(spark, sf)), P.tourism_near(r, X.tourism(spark, sf)),
        S.head_stations(r), X.requests(spark, sf),
    )


QUERIES["response_documents"] = documents


RESPONSE_ROUTE = """struct<
id: string, name: string, description: string, priority: string, distance_km: double, estimated_cost_usd: double,
elevation_gain_m: int, construction_difficulty: int, estimated_days: bigint, risk_score: int, bridges_required: bigint,
risk_factors: struct<terrain_risk: int, flood_risk: int, seasonal_risk: int>, social_impact_score: bigint,
road_utilization: struct<existing_road_km: double, new_construction_km: double, utilization_percent: double>,
construction_data: struct<
    total_waypoints: bigint, total_length_m: int, max_gradient_percent: double, avg_gradient_percent: double,
    earthwork: struct<total_cut_m3: bigint, total_fill_m3: bigint, balance_status: string, road_width_m: double>,
    field_instructions: struct<surveying: string, leveling: string, earthwork: string, gradient_control: string>>,
nearby_settlements: array<struct<name: string, population: string, distance_from_route_km: double>>,
tourism_spots: array<struct<name: string, tourism_score: int, distance_from_route_km: double>>,
river_crossings: array<struct<river_name: string, lat: double, lon: double>>,
data_sources_used: array<string>>"""


@query
def response_fields(spark, sf):
    """What the response documents say of each route, lists as texts."""
    shape = f"recommended_route_id string, metadata struct<routing_method: string>, routes array<{RESPONSE_ROUTE}>"
    read = documents(spark, sf).select("route_id", F.from_json("document", shape).alias("d"))
    rows = read.select("route_id", "d.metadata.routing_method", F.explode("d.routes").alias("r"))
    joined = lambda name, *parts: F.array_join(F.transform(f"r.{name}", lambda x: F.concat_ws(
        "|", *[x[p] for p in parts])), ";").alias(name)
    whole = rows.select(
        "route_id", "routing_method", "r.*", joined("nearby_settlements", "name", "population").alias("settlements_text"),
        joined("tourism_spots", "name", "tourism_score").alias("tourism_text"),
        joined("river_crossings", "river_name").alias("rivers_text"),
        F.array_join("r.data_sources_used", ",").alias("sources_text"),
    )
    return whole.select(
        *[x for x in whole.columns if x not in (
            "risk_factors", "road_utilization", "construction_data", "nearby_settlements", "tourism_spots",
            "river_crossings", "data_sources_used")],
        "risk_factors.*", "road_utilization.*", "construction_data.total_waypoints", "construction_data.total_length_m",
        "construction_data.max_gradient_percent", "construction_data.avg_gradient_percent",
        "construction_data.earthwork.*", c("construction_data.field_instructions.earthwork").alias("earthwork_text"),
        "construction_data.field_instructions.surveying", "construction_data.field_instructions.leveling",
        "construction_data.field_instructions.gradient_control",
    )


@query
def response_sizes(spark, sf):
    """List lengths of both routes in every response document."""
    size = lambda i, name: F.coalesce(F.json_array_length(
        F.get_json_object("document", f"$.routes[{i}].{name}")), F.lit(-1)).alias(name.split(".")[-1])
    lists = ("waypoints", "river_crossings", "nearby_settlements", "tourism_spots", "construction_data.detailed_waypoints")
    both = F.inline(F.array(*[
        F.struct(F.lit(v).alias("variant"), *[size(i, name) for name in lists])
        for i, v in enumerate(("shortest", "safest"))
    ]))
    return documents(spark, sf).select(
        "route_id", F.get_json_object("document", "$.recommended_route_id").alias("recommended"), both
    )
