import gzip
import hashlib
import json
import math
import random
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from roadplan import fixtures as X
from roadplan.operators import crossings as K
from roadplan.operators import network as N
from roadplan.operators.polyline import KEY
from roadplan.operators import simplify as simplification
from roadplan.operators.simplify import simplify_lines
from roadplan.plans import curve
from roadplan.sinks import documents as D
from roadplan.sinks import snapshot
from roadplan.sources import defaults, files, requests as intake
from roadplan.streaming.requests import request_stream, start_planning


def test_builtin_dimensions(spark):
    assert defaults.tourism_spots(spark).count() == 15
    assert defaults.major_routes(spark).count() == 2
    assert defaults.river_vertices(spark).select("name").distinct().count() == 12
    assert defaults.settlements(spark).count() == 21


def test_rainfall_file(spark, tmp_path):
    path = tmp_path / "rain.csv"
    path.write_text("code,district,annual\n1,UTTARKASHI,n/a\n2,Uttarkashi hills, 1800.5\n3,Uttarkashi,1200\n4,Pauri,900\n")
    rows = files.read_rainfall(spark, str(path), ["Uttarkashi", "Pauri", "Chamoli"]).collect()
    assert {r.district: r.annual_mm for r in rows} == {"Uttarkashi": 1800.5, "Pauri": 900.0, "Chamoli": 1500.0}


def test_geojson_features(spark, tmp_path):
    feature = lambda kind, coords, **props: {
        "type": "Feature", "geometry": {"type": kind, "coordinates": coords}, "properties": props}
    features = [
        feature("LineString", [[78.0, 30.0], [78.1, 30.1]], name="A", waterway="river"),
        feature("LineString", [[79.0, 30.0], [79.1, 30.1], [79.2, 30.2]]),
        feature("Point", [78.5, 30.5], name="P", place="town", population=12), feature("Point", [78.6]),
        feature("Point", [78.7, 30.7], population="Unknown"),
    ]
    whole, lines = tmp_path / "a.geojson", tmp_path / "b.jsonl"
    whole.write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    lines.write_text("\n".join(json.dumps(f) for f in features))
    for loaded in (files.read_features(spark, str(whole)), files.read_features(spark, str(lines), True)):
        river = files.line_vertices(loaded).orderBy("river_id", "seq").collect()
        assert [(r.name, r.seq, r.lon) for r in river] == [
            ("A", 0, 78.0), ("A", 1, 78.1), ("Unnamed River", 0, 79.0), ("Unnamed River", 1, 79.1), ("Unnamed River", 2, 79.2)]
        places = files.point_places(loaded).orderBy("feature_seq").collect()
        assert [(r.name, r.place, r.lat, r.population) for r in places] == [
            ("P", "town", 30.5, 12), ("Unnamed Settlement", "village", 30.7, None)]


def test_missing_file_falls_back(spark, tmp_path):
    default = defaults.river_vertices(spark)
    assert files.load_or_default(lambda: files.read_features(spark, str(tmp_path / "no.geojson")), default) is default
    (tmp_path / "bad.geojson").write_text("{not json")
    assert files.load_or_default(lambda: files.read_features(spark, str(tmp_path / "bad.geojson")), default) is default


def test_osm_xml(spark, tmp_path):
    path = tmp_path / "a.osm"
    path.write_text(
        '<osm><node id="1" lat="30.0" lon="78.0"/><node id="2" lat="30.1" lon="78.0"/>'
        '<way id="9"><nd ref="1"/><nd ref="2"/><tag k="highway" v="primary"/></way></osm>')
    ways, refs, nodes = files.read_osm_ways(spark, str(path))
    points = N.locate(refs, nodes)
    edges = N.directed_edges(points, N.filtered_ways(ways, points)).collect()
    assert [(e.edge_id, e.source, e.target, e.name) for e in edges] == [("9_0", 1, 2, "Unnamed_Road_9")]


def test_json_snapshot(spark, tmp_path):
    path = tmp_path / "network.json.gz"
    with gzip.open(path, "wt") as out:
        json.dump({"nodes": {"1": {"id": "1", "lat": 30.0, "lon": 78.0}},
                   "edges": {"e": {"id": "e", "source_node_id": "1", "target_node_id": "1"}}, "metadata": {"a": "b"}}, out)
    nodes, edges, metadata = files.read_snapshot_json(spark, str(path))
    assert nodes.first().elevation == 0 and metadata.first().value == "b"
    edge = edges.first()
    assert (edge.highway_type, edge.surface, edge.coordinates, edge.condition) == ("unclassified", "unpaved", [], None)
    assert files.read_snapshot_json(spark, str(tmp_path / "none.json.gz")) is None


def test_parquet_snapshot(spark, tmp_path):
    source, path = tmp_path / "source.osm", str(tmp_path / "snap")
    source.write_text("one")
    nodes = spark.createDataFrame([(1, 30.0, 78.0)], "node_id long, lat double, lon double")
    edges = spark.createDataFrame([("a", 1, 1, "primary"), ("b", 1, 1, "trunk")],
                                  "edge_id string, source long, target long, highway_type string")
    stats = N.network_stats(edges, nodes, edges, edges.limit(0))
    snapshot.write_snapshot(nodes, edges, stats, path, str(source))
    read_nodes, read_edges, metadata = snapshot.read_snapshot(spark, path)
    assert read_nodes.count() == 1 and read_edges.where("highway_type = 'trunk'").count() == 1
    assert metadata.first().pbf_hash == hashlib.sha256(b"one").hexdigest()
    assert snapshot.is_valid(metadata, str(source))
    source.write_text("two")
    assert not snapshot.is_valid(metadata, str(source))
    assert snapshot.read_snapshot(spark, str(tmp_path / "none")) is None


def test_request_intake(spark):
    body = json.dumps({"start": {"lat": "30.5", "lon": 78}, "end": {}})
    events = [
        (1, body), (2, json.dumps({"body": body})), (3, json.dumps({"body": json.loads(body)})), (4, "{}"),
        (5, '{"start":{"lat":"x"}}'), (6, '{"start":{"lat":null}}'), (7, "not json"),
    ]
    parsed = intake.parse_requests(spark.createDataFrame(events, "route_id long, event string"))
    good = {r.route_id: (r.start_lat, r.start_lon, r.end_lat) for r in intake.accepted(parsed).collect()}
    assert good == {1: (30.5, 78.0, 30.9993), 2: (30.5, 78.0, 30.9993), 3: (30.5, 78.0, 30.9993), 4: (30.7268, 78.4354, 30.9993)}
    assert sorted(r.route_id for r in intake.rejected(parsed).collect()) == [5, 6, 7]


def simplify(points, tolerance):
    """Plain recursive version for comparison."""
    def away(p, a, b):
        dx, dy = b[1] - a[1], b[0] - a[0]
        size = math.sqrt(dx * dx + dy * dy)
        if size == 0:
            return math.hypot(p[0] - a[0], p[1] - a[1])
        u = ((p[1] - a[1]) * dx + (p[0] - a[0]) * dy) / (size * size)
        u = min(1.0, max(0.0, u))
        return math.sqrt((p[1] - a[1] - u * dx) ** 2 + (p[0] - a[0] - u * dy) ** 2)

    def cut(lo, hi):
        far = max(range(lo + 1, hi), key=lambda i: away(points[i], points[lo], points[hi]), default=None)
        if far is None or away(points[far], points[lo], points[hi]) <= tolerance:
            return {lo, hi}
        return cut(lo, far) | cut(far, hi)

    return cut(0, len(points) - 1)


def test_simplified_lines_match_recursion(spark):
    r = random.Random(1)
    lines = {k: [(30 + i * 0.001, 78 + r.random() * 0.01) for i in range(n)] for k, n in enumerate([1, 2, 3, 40])}
    rows = [(k, i, *p) for k, line in lines.items() for i, p in enumerate(line)]
    points = spark.createDataFrame(rows, "line_id int, seq int, lat double, lon double")
    got = {(x.line_id, x.seq) for x in simplify_lines(points, 0.003).collect()}
    assert got == {(k, i) for k, line in lines.items() for i in simplify(line, 0.003)}


@pytest.fixture(scope="module")
def golden(spark):
    """The fixed request between two towns, planned over the built-in dimensions."""
    requests = spark.createDataFrame(
        [(1, 30.7268, 78.4354, 30.9993, 78.9394)],
        "route_id long, start_lat double, start_lon double, end_lat double, end_lon double")
    rivers = defaults.river_vertices(spark)
    plan = curve.plan_curve_routes(
        requests, rivers, K.river_segments(rivers), defaults.settlements(spark), defaults.tourism_spots(spark))
    return requests, plan.cache()


def test_golden_plan(golden):
    rows = {r.variant: r for r in golden[1].collect()}
    assert set(rows) == {"shortest", "safest"}
    assert rows["shortest"].distance_km == round(math.hypot(0.2725, 0.504) * 111, 2)
    for r in rows.values():
        assert all(0 <= x <= 100 for x in (r.risk_score, r.terrain_risk, r.flood_risk, r.seasonal_risk))
        assert r.total_cut_m3 >= 0 and r.total_fill_m3 >= 0 and r.bridges_required >= 1
        assert r.balance_m3 - (r.total_cut_m3 - r.total_fill_m3) in (-1, 0, 1)
    assert rows["safest"].terrain_risk < rows["shortest"].terrain_risk and rows["shortest"].recommended


def test_exports_are_well_formed(spark, golden, tmp_path):
    requests, plan = golden
    waypoints = curve.curve_routes(requests).select(*KEY, "waypoints")
    texts = D.waypoint_documents(plan.join(waypoints, KEY)).collect()
    for r in texts:
        ET.fromstring(r.kml.encode())
        ET.fromstring(r.gpx.encode())
        line = json.loads(r.geojson)["features"][0]
        assert len(line["geometry"]["coordinates"]) == {"shortest": 6, "safest": 8}[r.variant]
        assert line["properties"]["name"].endswith("Route")
    D.write_documents(D.waypoint_documents(plan.join(waypoints, KEY)), "kml", str(tmp_path / "kml"))
    written = {r.file_name: r.text for r in spark.read.parquet(str(tmp_path / "kml")).collect()}
    assert set(written.values()) == {r.kml for r in texts} and len(written) == 2
    name = min(written)
    D.export_files(spark, str(tmp_path / "kml"), str(tmp_path / "one"), [name])
    (only,) = (tmp_path / "one").rglob("*.txt")
    assert only.read_text().rstrip("\n") == written[name] and name in str(only)


def test_quotes_in_names_survive_geojson(spark, golden):
    requests, plan = golden
    named = plan.withColumn("name", F.lit('A "b" \\ c')).join(curve.curve_routes(requests).select(*KEY, "waypoints"), KEY)
    assert json.loads(D.waypoint_documents(named).first().geojson)["features"][0]["properties"]["name"] == 'A "b" \\ c'


def test_stream_plans_and_rejects(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    write = lambda name, rows: (source / name).write_text("\n".join(json.dumps(r) for r in rows))
    write("a.json", [{"route_id": 1, "event": "{}"}, {"route_id": 2, "event": '{"start":{"lat":"x"}}'}])
    plan = lambda batch: curve.route_metrics(batch).select(*KEY, "terrain_risk")
    run = lambda: start_planning(
        request_stream(spark, str(source)), plan, str(out), str(tmp_path / "cp"), availableNow=True).awaitTermination(120)
    assert run()
    write("b.json", [{"route_id": 3, "event": "{}"}])
    assert run()
    plans = spark.read.parquet(str(out / "plans")).select("route_id", "variant").collect()
    assert sorted(plans) == [(1, "safest"), (1, "shortest"), (3, "safest"), (3, "shortest")]
    assert [r.route_id for r in spark.read.parquet(str(out / "rejects")).collect()] == [2]


@pytest.mark.parametrize("leaf", [0, 7, 1000])
def test_simplified_lines_of_any_leaf(spark, leaf):
    """Rounds alone, rounds and settled spans, and settled spans alone give the same points, also of equal and odd ones."""
    rng = random.Random(3)
    rows = [(k, i, rng.randrange(5) / 10, rng.randrange(5) / 10) for k in range(6) for i in range(60)]
    rows += [(6, i // 2, i % 3 / 10, i % 5 / 10) for i in range(40)] + [(7, 1, 0.0, 0.0), (8, 1, 0.0, 0.0), (8, 2, 1.0, 1.0)]
    rows += [(9, i, None if i == 3 else float(i * i % 7), 0.5 * i) for i in range(20)] + [(None, 0, 1.0, 1.0)]
    points = spark.createDataFrame(rows, "line_id long, seq int, lat double, lon double")
    read = lambda df: sorted((r.line_id is None, r.line_id or 0, r.seq, r.lat, r.lon) for r in df.collect())
    assert read(simplify_lines(points, 0.15, leaf)) == read(simplify_lines(points, 0.15, 20))


def test_short_lines_take_no_rounds(spark, monkeypatch):
    """A line that every round would split near its start is settled at once."""
    written, table = [], simplification.checkpointed
    monkeypatch.setattr(simplification, "checkpointed", lambda df: written.append(1) or table(df))
    points = spark.createDataFrame([(1, i, float(i % 2), i / 100) for i in range(40)], "line_id long, seq int, lat double, lon double")
    assert simplify_lines(points, 0.1).count() == len(simplify([(float(i % 2), i / 100) for i in range(40)], 0.1))
    assert len(written) <= 4
