"""Road network from ways: filtering, quality log, nodes, directed edges and statistics.

Vertex rows ``(way_id, pos, ref, lat, lon)`` order a way's vertices by ``pos``, which may have gaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadplan.functions import cost as C
from roadplan.functions.geometry import haversine_m, round_places
from roadplan.operators.sequence import with_next
from roadplan.operators.spatial import HAVERSINE_M, checkpointed, places_within

SOCIAL_RADIUS_M = 1000.0
LOGGED_ISSUES = 10


def locate(way_refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Vertex rows with coordinates, stored; ways that refer to an unknown node are left out whole. Members are read once.

    Where every node is known, as in most networks, the rows are not shuffled and written a second time.
    """
    known = nodes.select(F.col("node_id").alias("ref"), "lat", "lon", F.lit(True).alias("known"))
    placed = checkpointed(way_refs.join(known, "ref", "left"))
    vertices = placed.select("way_id", "pos", "ref", "lat", "lon")
    unknown = checkpointed(placed.where("known is null").select("way_id").distinct())
    return vertices if unknown.isEmpty() else checkpointed(vertices.join(unknown, "way_id", "left_anti"))


def unlocated_ways(way_refs: DataFrame, nodes: DataFrame) -> DataFrame:
    known = nodes.select(F.col("node_id").alias("ref"))
    return way_refs.join(known, "ref", "left_anti").select("way_id").distinct()


def tagged_ways(ways: DataFrame) -> DataFrame:
    """Tags as columns, with defaults for a missing name or surface."""
    tag = lambda key: F.col("tags")[key]
    return ways.select(
        "way_id", tag("highway").alias("highway_type"),
        F.coalesce(tag("name"), F.concat(F.lit("Unnamed_Road_"), F.col("way_id"))).alias("name"),
        F.coalesce(tag("surface"), F.lit("unpaved")).alias("surface"), tag("condition").alias("condition"),
    )


def kept_way_ids(
    ways: DataFrame, vertices: DataFrame, classes: list[str] | None = C.MAJOR_CLASSES,
    bbox: tuple[float, float, float, float] | None = None,
) -> DataFrame:
    """Ways of the given classes with at least two vertices, any of them inside ``bbox`` if given.

    ``bbox`` is (min lat, min lon, max lat, max lon), edges included.
    """
    # vertices and ways are counted together, so that ids are shuffled once and tags not at all
    highway, no = F.col("tags")["highway"], F.lit(False)
    major = highway.isNotNull() if classes is None else highway.isin(classes)
    inside = F.lit(True)
    if bbox is not None:
        south, west, north, east = bbox
        inside = F.col("lat").between(south, north) & F.col("lon").between(west, east)
    marks = vertices.select("way_id", F.lit(1).alias("n"), inside.alias("inside"), no.alias("major")).unionAll(
        ways.where(major).select("way_id", F.lit(0).alias("n"), no.alias("inside"), F.lit(True).alias("major")))
    found = marks.groupBy("way_id").agg(
        F.sum("n").alias("n"), F.max("inside").alias("inside"), F.max("major").alias("major"))
    return found.where((F.col("n") > 1) & F.col("inside") & F.col("major")).select("way_id")


def filtered_ways(ways: DataFrame, vertices: DataFrame, classes=C.MAJOR_CLASSES, bbox=None) -> DataFrame:
    return tagged_ways(ways.join(kept_way_ids(ways, vertices, classes, bbox), "way_id", "left_semi"))


def quality_issues(ways: DataFrame, kept: DataFrame, unlocated: DataFrame | None = None) -> DataFrame:
    """One row per kept way and missing tag, and one per way with an unknown node."""
    missing = lambda key, kind, text: F.when(F.col("tags")[key].isNull(), F.struct(
        F.lit(kind).alias("kind"),
        F.concat(F.lit("Road "), F.col("way_id"), F.lit(text)).alias("issue"),
    ))
    checks = F.array_compact(F.array(
        missing("name", "name", " missing name, using default"),
        missing("surface", "surface", " missing surface, defaulting to unpaved"),
    ))
    issues = ways.join(kept.select("way_id"), "way_id", "left_semi").select("way_id", F.inline(checks))
    if unlocated is not None:
        issues = issues.unionByName(unlocated.select(
            "way_id", F.lit("location").alias("kind"),
            F.concat(F.lit("Error processing way "), F.col("way_id"), F.lit(": invalid location")).alias("issue"),
        ))
    return issues


def first_issues(issues: DataFrame, k: int = LOGGED_ISSUES) -> DataFrame:
    return issues.orderBy("way_id", "kind").limit(k)


def distinct_nodes(vertices: DataFrame) -> DataFrame:
    """Every referenced node once, at the place where it is first seen."""
    place = F.min(F.struct("way_id", "pos", "lat", "lon")).alias("first")
    return vertices.groupBy(F.col("ref").alias("node_id")).agg(place).select(
        "node_id", "first.lat", "first.lon", F.lit(0).alias("elevation")
    )


def directed_edges(vertices: DataFrame, ways: DataFrame) -> DataFrame:
    """Edges between consecutive vertices, in way direction only, with the way's attributes.

    ``ways`` are tagged ways; vertices of other ways are dropped.
    """
    joined = with_next(vertices, "way_id", "pos", ["ref", "lat", "lon"]).where("next_ref is not null").select(
        "way_id", "pos", F.col("ref").alias("source"), F.col("next_ref").alias("target"), F.col("lat").alias("lat1"),
        F.col("lon").alias("lon1"), F.col("next_lat").alias("lat2"), F.col("next_lon").alias("lon2"))
    return joined.join(ways, "way_id").select(
        F.concat_ws("_", "way_id", "pos").alias("edge_id"), "way_id", "pos", "source", "target",
        "lat1", "lon1", "lat2", "lon2",
        haversine_m(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")).alias("distance_m"),
        "name", "highway_type", "surface", "condition",
    )


def bidirectional(edges: DataFrame) -> DataFrame:
    """Edges in both directions, for callers that want to ignore way direction."""
    back = edges.select(*[
        F.concat("edge_id", F.lit("r")).alias(c) if c == "edge_id"
        else F.col({"source": "target", "target": "source", "lat1": "lat2", "lat2": "lat1",
                    "lon1": "lon2", "lon2": "lon1"}.get(c, c)).alias(c)
        for c in edges.columns
    ])
    return edges.unionByName(back)


def way_lengths(edges: DataFrame) -> DataFrame:
    return edges.groupBy("way_id").agg(F.count("*").alias("edges"), F.sum("distance_m").alias("distance_m"))


def adjacency(edges: DataFrame) -> DataFrame:
    """Outgoing and incoming edge counts per node."""
    role = F.inline(F.array(
        F.struct(F.col("source").alias("node_id"), F.lit(1).alias("out"), F.lit(0).alias("into")),
        F.struct(F.col("target").alias("node_id"), F.lit(0).alias("out"), F.lit(1).alias("into")),
    ))
    return edges.select(role).groupBy("node_id").agg(
        F.sum("out").alias("out_degree"), F.sum("into").alias("in_degree")
    )


LIST_EDGES = 10_000


def adjacency_lists(edges: DataFrame, list_edges: int = LIST_EDGES) -> DataFrame:
    """(node_id, part, out, into): edges that leave and enter a node, as lists of (edge_id, node at the other end).

    Lists are in the order of the edge ids. A node of more than ``list_edges`` edges is dealt over several parts
    by a hash of the edge id, so no list grows with a hub.
    """
    role = F.inline(F.array(
        F.struct(F.col("source").alias("node_id"), F.lit(0).alias("side"), F.col("target").alias("other")),
        F.struct(F.col("target").alias("node_id"), F.lit(1).alias("side"), F.col("source").alias("other")),
    ))
    ends = edges.select("edge_id", role)
    hubs = ends.groupBy("node_id").count().where(F.col("count") > list_edges).select(
        "node_id", F.ceil(F.col("count") / list_edges).alias("parts"))
    dealt = ends.join(hubs, "node_id", "left").withColumn(
        "part", F.pmod(F.xxhash64("edge_id"), F.coalesce("parts", F.lit(1))).cast("int"))
    lists = lambda side: F.array_sort(F.collect_list(
        F.when(F.col("side") == side, F.struct("edge_id", F.col("other").alias("node")))))
    return dealt.groupBy("node_id", "part").agg(lists(0).alias("out"), lists(1).alias("into"))


def network_stats(ways: DataFrame, nodes: DataFrame, edges: DataFrame, issues: DataFrame) -> DataFrame:
    """One row of totals."""
    one = lambda df, name: df.select(F.lit(name).alias("what"))
    counted = (
        one(ways, "total_roads").unionAll(one(nodes, "total_nodes"))
        .unionAll(one(edges, "total_edges")).unionAll(one(issues, "data_quality_issues"))
    )
    names = ["total_roads", "total_nodes", "total_edges", "data_quality_issues"]
    return counted.agg(*[F.count(F.when(F.col("what") == n, 1)).alias(n) for n in names])


def near_settlement(edges: DataFrame, settlements: DataFrame) -> DataFrame:
    """``edges`` with ``near_settlement``: some settlement is under 1 km from the edge's midpoint."""
    middle = edges.withColumn("lat", (F.col("lat1") + F.col("lat2")) / 2).withColumn(
        "lon", (F.col("lon1") + F.col("lon2")) / 2
    )
    targets = settlements.select(F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon"))
    near = checkpointed(places_within(middle, targets, HAVERSINE_M, SOCIAL_RADIUS_M)).withColumn("near", F.lit(True))
    return middle.join(near, ["lat", "lon"], "left").select(
        *edges.columns, F.coalesce("near", F.lit(False)).alias("near_settlement"))


def edge_costs(edges: DataFrame) -> DataFrame:
    """``edges`` with one column per criterion; ``social`` only where ``near_settlement`` is known."""
    m, c = F.col("distance_m"), F.col
    costs = {
        "shortest": C.cost_shortest(m), "safest": C.cost_safest(m, c("highway_type")),
        "budget": C.cost_budget(m, c("surface")),
    }
    if "near_settlement" in edges.columns:
        costs["social"] = C.cost_social(m, c("near_settlement"))
    return edges.select("*", *[cost.alias(name) for name, cost in costs.items()])


def classified_segments(segments: DataFrame, edges: DataFrame) -> DataFrame:
    """Route segments with construction type and cost factor; an unknown edge is new construction."""
    known = edges.select(
        "edge_id", F.col("highway_type").alias("edge_highway"), F.col("surface").alias("edge_surface")
    )
    return segments.join(known, "edge_id", "left").select(
        *segments.columns, C.construction_type(F.col("edge_highway")).alias("construction_type"),
        C.cost_factor(F.col("edge_highway"), F.col("edge_surface")).alias("cost_factor"),
    )


def construction_stats(classified: DataFrame, *key: str) -> DataFrame:
    """New and upgraded kilometres, shares and cost per route."""
    km, kind = F.col("distance_m") / 1000, F.col("construction_type")
    new = F.sum(F.when(kind == "new_construction", km).otherwise(0.0))
    upgrade = F.sum(F.when(kind == "new_construction", 0.0).otherwise(km))
    sums = classified.groupBy(*key).agg(
        new.alias("new"), upgrade.alias("upgrade"), F.sum(km).alias("total"),
        F.sum(C.network_segment_cost(F.col("distance_m"), kind)).alias("estimated_cost"),
    )
    share = F.when(F.col("total") > 0, F.col("upgrade") / F.col("total") * 100).otherwise(0.0)
    saved = F.when(F.col("total") > 0, F.col("upgrade") * 0.6 / F.col("total") * 100).otherwise(0.0)
    return sums.select(
        *key, F.col("total").alias("total_distance_km"),
        round_places(F.col("new"), 2).alias("new_construction_km"), round_places(F.col("upgrade"), 2).alias("upgrade_existing_km"),
        round_places(share, 1).alias("utilization_percent"), round_places(saved, 1).alias("cost_savings_percent"), "estimated_cost",
    )
