import heapq
import json
import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from roadplan import fixtures as X
from roadplan.operators import network as N
from roadplan.operators import paths as P
from roadplan.operators import polyline as L
from roadplan.operators.two_sided import two_sided_paths
from roadplan.plans.pipeline import OUTSIDE, Surroundings, plan_events
from roadplan.plans import fallback as B
from roadplan.plans import network_routes as G


def graph(spark, n=60, degree=3, seed=0, extra=()):
    """Random places joined to near ones, as nodes and priced edges."""
    r = random.Random(seed)
    nodes = [(i, 30 + r.random() * 0.5, 78 + r.random() * 0.5) for i in range(n)]
    near = lambda i: sorted(range(n), key=lambda j: (nodes[i][1] - nodes[j][1]) ** 2 + (nodes[i][2] - nodes[j][2]) ** 2)
    links = [(i, j) for i in range(n) for j in near(i)[1:degree + 1]] + list(extra)
    kinds = ["primary", "track", "tertiary"]
    rows = [(f"e{k}", i, j, nodes[i][1], nodes[i][2], nodes[j][1], nodes[j][2], kinds[r.randrange(3)], "gravel")
            for k, (i, j) in enumerate(links)]
    edges = spark.createDataFrame(
        rows, "edge_id string, source long, target long, lat1 double, lon1 double, lat2 double, lon2 double, "
        "highway_type string, surface string",
    ).withColumn("distance_m", N.haversine_m(*[F.col(c) for c in ("lat1", "lon1", "lat2", "lon2")]))
    edges = N.edge_costs(edges.withColumn("name", F.lit("x")))
    return spark.createDataFrame(nodes, "node_id long, lat double, lon double"), edges


def dijkstra(edges, criterion, source):
    out = defaultdict(list)
    for e in edges:
        out[e.source].append((e.target, e[criterion]))
    cost, heap = {source: 0.0}, [(0.0, source)]
    while heap:
        d, v = heapq.heappop(heap)
        if d > cost[v]:
            continue
        for w, c in out[v]:
            if d + c < cost.get(w, float("inf")):
                cost[w] = d + c
                heapq.heappush(heap, (d + c, w))
    return cost


def searches(spark, pairs):
    return spark.createDataFrame(
        [(c, a, b) for a, b in pairs for c in ("shortest", "safest")], "criterion string, source long, target long")


@pytest.mark.parametrize("contracted", [False, True])
def test_paths_match_dijkstra(spark, contracted):
    nodes, edges = graph(spark, extra=[(0, 0), (1, 2), (1, 2)])
    pairs = [(0, 41), (7, 12), (33, 5), (20, 21), (3, 3)]
    wanted = searches(spark, pairs)
    rows = edges.collect()
    if contracted:
        keep = wanted.select(F.explode(F.array("source", "target")).alias("node_id")).distinct()
        members = P.chain_members(edges, keep)
        table = P.least_cost_paths(wanted, nodes, P.contract(edges, members, ["shortest", "safest"]), ["shortest", "safest"])
        steps = P.expand(P.path_edges(table), members)
    else:
        table = P.least_cost_paths(wanted, nodes, edges, ["shortest", "safest"])
        steps = P.path_edges(table).withColumn("rank", F.lit(0))
    got = {(r.criterion, r.source, r.target): r.cost for r in P.arrivals(table).collect()}
    by_id = {e.edge_id: e for e in rows}
    ordered = defaultdict(list)
    for r in sorted(steps.collect(), key=lambda r: (r.hop, r["rank"])):
        ordered[(r.criterion, r.source, r.target)].append(by_id[r.edge_id])
    for a, b in pairs[:-1]:
        for criterion in ("shortest", "safest"):
            best = dijkstra(rows, criterion, a).get(b)
            key = (criterion, a, b)
            assert (key in got) == (best is not None)
            if best is not None:
                assert got[key] == pytest.approx(best)
                path = ordered[key]
                assert path[0].source == a and path[-1].target == b
                assert all(x.target == y.source for x, y in zip(path, path[1:]))
                assert sum(e[criterion] for e in path) == pytest.approx(best)
    assert ("shortest", 3, 3) not in got


def test_round_limit_is_reported(spark):
    nodes, edges = graph(spark)
    assert P.least_cost_paths(searches(spark, [(0, 41)]), nodes, edges, ["shortest", "safest"], max_rounds=1).unfinished


def test_cut_searches_have_no_cost(spark):
    nodes, edges = graph(spark)
    table = P.least_cost_paths(searches(spark, [(0, 41)]), nodes, edges, ["shortest", "safest"], max_rounds=1)
    assert {(r.source, r.target) for r in table.open_searches.collect()} == {(0, 41)}
    assert P.arrivals(table).isEmpty() and P.path_edges(table).isEmpty()
    at = {r.node_id: (r.lat, r.lon) for r in nodes.collect()}
    requests = spark.createDataFrame(
        [(1, *at[0], *at[41])], "route_id long, start_lat double, start_lon double, end_lat double, end_lon double")
    assert G.find_routes(requests, nodes, edges, max_rounds=1, contract=False).status.first().status == "UNFINISHED"


def chain(spark, n, two_way):
    nodes = spark.createDataFrame([(i, 29 + i / 5000, 79.0) for i in range(n)], "node_id long, lat double, lon double")
    both = [(i, i + 1) for i in range(n - 1)] + ([(i + 1, i) for i in range(n - 1)] if two_way else [])
    edges = spark.createDataFrame(
        [(f"{a}-{b}", a, b, 29 + a / 5000, 79.0, 29 + b / 5000, 79.0, 0.5 + (a + b) % 3) for a, b in both],
        "edge_id string, source long, target long, lat1 double, lon1 double, lat2 double, lon2 double, hours double")
    return nodes, edges


@pytest.mark.parametrize("two_way", [False, True])
def test_long_chain_under_a_cost_of_the_callers_own(spark, two_way):
    n = 3000
    nodes, edges = chain(spark, n, two_way)
    wanted = spark.createDataFrame([("hours", 3, n - 2)], "criterion string, source long, target long")
    keep = spark.createDataFrame([(3,), (n - 2,)], "node_id long")
    members = P.chain_members(edges, keep)
    short = P.contract(edges, members, ["hours"])
    assert short.count() == (6 if two_way else 3)
    factors = P.least_factors(edges, ["hours"], P.LEAST_FACTOR)
    table = P.least_cost_paths(wanted, nodes, short, ["hours"], factors=factors)
    steps = P.expand(P.path_edges(table), members).orderBy("hop", "rank").collect()
    assert [r.edge_id for r in steps] == [f"{i}-{i + 1}" for i in range(3, n - 2)]
    assert P.arrivals(table).first().cost == pytest.approx(sum(0.5 + (2 * i + 1) % 3 for i in range(3, n - 2)))


def test_margin_and_pointers_without_contraction(spark):
    nodes, edges = chain(spark, 12, True)
    wanted = spark.createDataFrame([("hours", 0, 11)], "criterion string, source long, target long")
    table = P.least_cost_paths(wanted, nodes, edges, ["hours"])
    assert [r.hop for r in P.path_edges(table).orderBy("hop").collect()] == list(range(1, 12))


def test_unknown_or_bad_costs_are_errors(spark):
    nodes, edges = chain(spark, 4, False)
    wanted = spark.createDataFrame([("pain", 0, 3)], "criterion string, source long, target long")
    for name in ("pain", "hours"):
        with pytest.raises(ValueError):
            P.least_cost_paths(wanted, nodes, edges, [name])
    with pytest.raises(ValueError):
        P.least_factors(edges.withColumn("hours", -F.col("hours")), ["hours"], {})


def test_chains_and_loops(spark):
    rows = [(f"c{i}", i, i + 1) for i in range(9)] + [("x", 4, 20), ("l1", 30, 31), ("l2", 31, 30)]
    edges = spark.createDataFrame(rows, "edge_id string, source long, target long")
    keep = spark.createDataFrame([(7,)], "node_id long")
    chains = {r.edge_id: (r.chain_id, r["rank"]) for r in P.chain_members(edges, keep).collect()}
    assert chains["c3"] == ("c0", 3) and chains["c4"] == ("c4", 0) and chains["c6"] == ("c4", 2)
    assert chains["c7"] == ("c7", 0) and chains["c8"] == ("c7", 1)
    assert chains["l1"] == ("l1", 0) and chains["l2"] == ("l2", 0)


def test_route_status_and_method(spark):
    nodes, edges = graph(spark, n=40, degree=2, seed=3)
    at = {r.node_id: (r.lat, r.lon) for r in nodes.collect()}
    reach = dijkstra(edges.collect(), "shortest", 0)
    there = next(i for i in reach if i != 0)
    far = (29.0, 80.5)
    cases = [(1, at[0], at[there]), (2, far, at[0]), (3, at[0], far), (4, at[0], at[0]), (5, far, (28.7, 80.9))]
    lost = [i for i in at if i not in reach]
    if lost:
        cases.append((6, at[0], at[lost[0]]))
    requests = spark.createDataFrame(
        [(k, *a, *b) for k, a, b in cases],
        "route_id long, start_lat double, start_lon double, end_lat double, end_lon double")
    found = G.find_routes(requests, nodes, edges, contract=True)
    status = {r.route_id: r.status for r in found.status.collect()}
    assert status[1] == "OK" and status[2] == "NO_SNAP_POINT_START" and status[3] == "NO_SNAP_POINT_END"
    assert status[4] == "SAME_NODE" and status.get(6, "NO_PATH_EXISTS") == "NO_PATH_EXISTS"
    routes = B.routed(requests, found.status, found.waypoints, G.node_targets(nodes, B.SAMPLE_SNAP_M)).collect()
    methods = defaultdict(set)
    for r in routes:
        methods[r.route_id].add(r.routing_method)
    assert all(len(m) == 1 for m in methods.values()) and set(methods) == {k for k, *_ in cases}
    assert methods[1] == {"osm_network"} and methods[2] == {"hybrid"} and methods[4] == {"mathematical"}
    assert methods[5] == {"mathematical"}


@pytest.mark.parametrize("n", [1, 2, 25, 26, 47, 48, 100])
def test_thinning(spark, n):
    points = spark.range(n).select(
        F.lit(1).alias("route_id"), F.lit("shortest").alias("variant"), "id",
        (30 + F.col("id") / 1000).alias("lat"), F.lit(78.0).alias("lon"))
    kept = [r.id for r in L.thin_points(points, "id").orderBy("seq").collect()]
    want = list(range(n)) if n <= 25 else [0] + [i * (n // 24) for i in range(1, 24)] + [n - 1]
    assert kept == want and len(kept) <= 25


def test_repeats_collapse(spark):
    lats = [1.0, 1.0, 2.0, 2.0, 2.0, 1.0]
    points = spark.createDataFrame([(1, "s", i, x, 78.0) for i, x in enumerate(lats)],
                                   "route_id int, variant string, i int, lat double, lon double")
    assert [r.lat for r in L.collapse_repeats(points, "i").orderBy("i").collect()] == [1.0, 2.0, 1.0]


@settings(max_examples=50, deadline=None)
@given(st.integers(2, 400), st.integers(2, 60))
def test_resampling_keeps_both_ends(n, keep):
    kept = L.resample_indices(n, keep)
    assert kept[0] == 0 and kept[-1] == n - 1 and kept == sorted(kept) and len(kept) == keep


def test_ways(spark):
    ways = spark.createDataFrame(
        [(1, {"highway": "primary", "name": "A", "surface": "asphalt"}), (2, {"highway": "track"}),
         (3, {"highway": "trunk"}), (4, {"highway": "primary"}), (5, {}), (6, {"highway": "primary"})],
        "way_id long, tags map<string,string>")
    refs = spark.createDataFrame(
        [(1, 0, 10), (1, 1, 11), (1, 2, 12), (2, 0, 10), (2, 1, 12), (3, 0, 10), (4, 0, 12), (4, 1, 13), (5, 0, 10),
         (5, 1, 11), (6, 0, 10), (6, 1, 99)], "way_id long, pos int, ref long")
    nodes = spark.createDataFrame([(10, 30.0, 78.0), (11, 30.1, 78.0), (12, 30.2, 78.0), (13, 31.0, 79.0)],
                                  "node_id long, lat double, lon double")
    points = N.locate(refs, nodes)
    ids = lambda df: sorted(r.way_id for r in df.select("way_id").collect())
    assert ids(N.filtered_ways(ways, points)) == [1, 4]
    assert ids(N.filtered_ways(ways, points, None)) == [1, 2, 4]
    assert ids(N.filtered_ways(ways, points, bbox=(30.05, 77.0, 30.15, 79.0))) == [1]
    assert ids(N.unlocated_ways(refs, nodes)) == [6]
    kept = N.filtered_ways(ways, points)
    assert {r.way_id: (r.name, r.surface) for r in kept.collect()} == {
        1: ("A", "asphalt"), 4: ("Unnamed_Road_4", "unpaved")}
    issues = N.quality_issues(ways, kept, N.unlocated_ways(refs, nodes))
    assert sorted((r.way_id, r.kind) for r in issues.collect()) == [(4, "name"), (4, "surface"), (6, "location")]
    edges = N.directed_edges(points, kept)
    assert sorted((r.edge_id, r.source, r.target) for r in edges.collect()) == [
        ("1_0", 10, 11), ("1_1", 11, 12), ("4_0", 12, 13)]
    assert N.bidirectional(edges).count() == 6
    stats = N.network_stats(kept, N.distinct_nodes(points), edges, issues).first()
    assert (stats.total_roads, stats.total_edges, stats.data_quality_issues) == (2, 3, 3)


def test_social_edges(spark):
    edges = spark.createDataFrame([("a", 30.0, 78.0, 30.01, 78.0), ("b", 30.2, 78.0, 30.21, 78.0)],
                                  "edge_id string, lat1 double, lon1 double, lat2 double, lon2 double")
    places = spark.createDataFrame([(0, 30.012, 78.001)], "feature_seq long, lat double, lon double")
    assert {r.edge_id: r.near_settlement for r in N.near_settlement(edges, places).collect()} == {"a": True, "b": False}


def test_events_become_plans_or_rejects(spark, sf):
    event = lambda lat1, lon1, lat2, lon2: json.dumps(
        {"start": {"lat": lat1, "lon": lon1}, "end": {"lat": lat2, "lon": lon2}})
    events = spark.createDataFrame([
        (1, "ASIA", event(30.0, 78.0, 30.02, 78.02)), (2, None, event(30.3, 79.0, 30.3, 79.1)), (3, None, "no JSON"),
        (4, None, event(20.0, 78.0, 30.0, 78.0)), (5, None, event(31.0, 80.5, 31.1, 80.9)),
    ], "route_id long, district string, event string")
    nodes = spark.createDataFrame(
        [("a", 30.0, 78.0), ("b", 30.02, 78.02), ("c", 30.3, 79.05)], "node_id string, lat double, lon double")
    edges = spark.createDataFrame(
        [("e", "a", "b", 30.0, 78.0, 30.02, 78.02, 2940.0, "R", "primary", "paved", 2940.0, 2352.0)],
        "edge_id string, source string, target string, lat1 double, lon1 double, lat2 double, lon2 double, distance_m double, "
        "name string, highway_type string, surface string, shortest double, safest double")
    around = Surroundings(X.river_vertices(spark, sf), X.settlements(spark, sf), X.tourism(spark, sf), X.rainfall(spark, sf))
    plans, rejects = plan_events(events, nodes, edges, around)
    methods = {1: "osm_network", 2: "hybrid", 5: "mathematical"}
    assert sorted((r.route_id, r.variant, r.routing_method) for r in plans.collect()) == sorted(
        (i, v, m) for i, m in methods.items() for v in ("shortest", "safest"))
    assert {r.route_id: r.reason for r in rejects.collect()} == {3: "not JSON", 4: OUTSIDE}


def test_edges_beyond_both_radii_are_not_stored(spark):
    """A chain of four roads with many dead ends that reach past half of the path."""
    chain = [(f"c{i}", i, i + 1, 100.0) for i in range(4)]
    ends = [(f"d{i}_{j}", i, 100 * (i + 1) + j, 300.0) for i in range(5) for j in range(30)]
    edges = spark.createDataFrame(chain + ends, "edge_id string, source long, target long, hours double")
    nodes = edges.selectExpr("inline(array(struct(source as node_id), struct(target as node_id)))").distinct().selectExpr(
        "node_id", "30.0d as lat", "79.0d as lon")
    wanted = spark.createDataFrame([("hours", 0, 4)], "criterion string, source long, target long")
    table = two_sided_paths(wanted, nodes, edges, ["hours"], factors={"hours": 0.0})
    assert P.arrivals(table).first().cost == 400.0
    assert sorted((r.hop, r.edge_id) for r in P.path_edges(table).collect()) == [(i + 1, f"c{i}") for i in range(4)]
    assert table.labels.count() <= 5


def test_known_vertices_are_written_once(spark, monkeypatch):
    """Without unknown nodes the located vertices are the stored rows themselves, not another join."""
    refs = spark.createDataFrame([(w, p, (w + p) % 5) for w in range(6) for p in range(3)], "way_id long, pos int, ref long")
    nodes = spark.createDataFrame([(i, 30.0 + i, 78.0) for i in range(5)], "node_id long, lat double, lon double")
    for known, ways in ((nodes, 6), (nodes.where("node_id < 4"), 3)):
        located = N.locate(refs, known)
        assert located.select("way_id").distinct().count() == ways
        assert "Join" not in located._jdf.queryExecution().executedPlan().toString()
    ways = spark.createDataFrame([(w, {"highway": "primary"}) for w in (0, 1, None)], "way_id long, tags map<string,string>")
    plan = N.kept_way_ids(ways, N.locate(refs, nodes), bbox=(29.0, 77.0, 40.0, 79.0))._jdf.queryExecution().optimizedPlan()
    assert "Join" not in plan.toString()


def test_snapshot_counts_the_stored_network(spark, sf, monkeypatch):
    """The snapshot's totals come from the nodes and edges it has stored."""
    from roadplan import queries as Q

    Q.network(spark, sf)
    monkeypatch.setattr(N, "directed_edges", None)
    monkeypatch.setattr(N, "distinct_nodes", None)
    row = Q.QUERIES["network_snapshot"](spark, sf).first()
    nodes, roads = Q.network(spark, sf)
    assert (row.total_nodes, row.total_edges) == (nodes.count(), roads.count())
