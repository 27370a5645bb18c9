"""One SQL text per query name."""

from oracle import parts as O
from oracle.parts import MAJOR, PAVED, elevation, flood_base, haversine, planar, with_ctes
from roadplan.sources import defaults

SQL: dict[str, str] = {}

SQL["curve_waypoints"] = with_ctes("wp", "SELECT route_id, variant, seq, lat, lon, elevation FROM wp")
SQL["terrain_risk"] = with_ctes("terrain", "SELECT route_id, variant, terrain_risk FROM terrain")
SQL["elevation_gain"] = with_ctes("terrain_raw", "SELECT route_id, variant, elevation_gain_m FROM terrain_raw")
SQL["variant_pairs"] = with_ctes("terrain_raw", """
SELECT a.route_id, a.terrain AS terrain_shortest, b.terrain AS terrain_safest,
       CASE WHEN b.terrain >= a.terrain THEN greatest(20, a.terrain - 10) ELSE b.terrain END AS terrain_adjusted
FROM terrain_raw a JOIN terrain_raw b ON a.route_id = b.route_id
WHERE a.variant = 'shortest' AND b.variant = 'safest'""")
SQL["request_distance"] = with_ctes("request", f"""
SELECT route_id, round({haversine('start_lat', 'start_lon', 'end_lat', 'end_lon')}, 3) AS haversine_m,
       round({planar('start_lat', 'start_lon', 'end_lat', 'end_lon')} * 111, 6) AS planar_km FROM request""")
SQL["flood_band"] = with_ctes("node", f"""
SELECT node_id, {elevation('lat', 'lon')} AS elevation, {flood_base(elevation('lat', 'lon'))} AS flood_base FROM node""")
SQL["site_risks"] = with_ctes("site", "SELECT route_id, rainfall_risk, flood_base_risk FROM site")
SQL["nearest_river"] = with_ctes("site", """
SELECT route_id, elev AS mid_elevation, round(CASE WHEN river_km <= 3 THEN river_km END, 6) AS river_km FROM site""")
SQL["raw_crossings"] = with_ctes("raw_crossing", """
SELECT route_id, variant, seg, river_id, river_name, lat, lon FROM raw_crossing""")
SQL["river_crossings"] = with_ctes("crossing", "SELECT * FROM crossing")
SQL["settlements_near"] = with_ctes("near_settlement", """
SELECT * EXCLUDE (wp_seq, feature_seq) FROM (SELECT *, row_number() OVER (PARTITION BY route_id, variant
       ORDER BY distance_from_route_km, wp_seq, feature_seq) AS rank FROM near_settlement) WHERE rank <= 20""")
SQL["tourism_near"] = with_ctes("near_tourism", """
SELECT * EXCLUDE (wp_seq, feature_seq) FROM (SELECT *, row_number() OVER (PARTITION BY route_id, variant
       ORDER BY score DESC, wp_seq, feature_seq) AS rank FROM near_tourism) WHERE rank <= 3""")
SQL["social_score"] = with_ctes("social", """
SELECT * FROM social WHERE settlements > 0 OR tourism_score > 0""")
SQL["road_utilization"] = with_ctes("utilization", "SELECT * FROM utilization")
SQL["survey_points"] = with_ctes("survey", """
SELECT route_id, variant, idx, chainage_m, round(lat, 6) AS lat, round(lon, 6) AS lon, ground AS ground_elevation_m,
       trunc(design)::INTEGER AS design_elevation_m, round(depth, 2) AS cut_fill_depth_m, kind AS cut_fill_type,
       round(volume, 2) AS cut_fill_volume_m3, round(gradient, 2) AS gradient_percent FROM survey WHERE idx < 10""")
SQL["survey_classes"] = with_ctes("survey", """
SELECT route_id, variant, kind AS cut_fill_type, count(*) AS stations, sum(chainage_m)::BIGINT AS chainage_sum,
       sum(ground)::BIGINT AS ground_sum, sum(trunc(design))::BIGINT AS design_sum,
       round(sum(round(depth, 2) ORDER BY idx), 1) AS depth_sum,
       round(sum(round(gradient, 2) ORDER BY idx), 1) AS gradient_sum
FROM survey GROUP BY route_id, variant, kind""")
SQL["earthwork"] = with_ctes("earthwork", """
SELECT route_id, variant, total_waypoints, total_length_m, max_gradient_percent, avg_gradient_percent,
       trunc(cut)::BIGINT AS total_cut_m3, trunc(fill)::BIGINT AS total_fill_m3, trunc(cut - fill)::BIGINT AS balance_m3,
       balance_status, round(slope_pct, 4) AS natural_gradient_percent,
       round(greatest(-10, least(10, slope_pct)), 4) AS design_gradient_percent FROM earthwork""")
SQL["field_instructions"] = with_ctes("earthwork", """
SELECT route_id, variant,
       'Use GPS device to navigate to each chainage point. Mark with survey pegs every 50m.' AS surveying,
       'Use dumpy level or total station to set formation level at design elevation.' AS leveling,
       'Cut ' || trunc(cut)::BIGINT || ' m³ and fill ' || trunc(fill)::BIGINT || ' m³. ' || CASE balance_status
         WHEN 'balanced' THEN 'Balanced' WHEN 'excess_cut' THEN 'Excess Cut' ELSE 'Excess Fill' END || '.' AS earthwork,
       'Maximum gradient: ' || max_gradient_percent::DOUBLE || '%. Ensure proper drainage.' AS gradient_control
FROM earthwork""")
SQL["route_plan"] = with_ctes("plan", """
SELECT route_id, variant, CASE variant WHEN 'safest' THEN 'route-2' ELSE 'route-1' END AS id,
       CASE variant WHEN 'safest' THEN 'Safest Route' ELSE 'Shortest Route' END AS name,
       CASE variant WHEN 'safest' THEN 'Minimizes terrain and flood risks' ELSE 'Minimizes distance and travel time' END
       AS description, CASE variant WHEN 'safest' THEN 'Safety' ELSE 'Distance' END AS priority,
       round(km, 2) AS distance_km, elevation_gain_m,
       least(100, trunc(base + terrain_risk * 0.5::DOUBLE))::INTEGER AS construction_difficulty,
       round((new_construction_km * 35000 + existing_road_km * 5000) * (1 + terrain_risk / 100)
             + bridges_required * 25000, 2) AS estimated_cost,
       round_even(km * 15 * (1 + terrain_risk / 300) + bridges_required * 30, 0)::BIGINT AS estimated_days,
       risk_score, terrain_risk, flood_risk, seasonal_risk, bridges_required, total_distance_km, existing_road_km,
       new_construction_km, utilization_percent, cost_savings_percent, settlements, social_impact_score,
       total_waypoints, total_length_m, max_gradient_percent, avg_gradient_percent, trunc(cut)::BIGINT AS total_cut_m3,
       trunc(fill)::BIGINT AS total_fill_m3, trunc(cut - fill)::BIGINT AS balance_m3, balance_status, recommended
FROM plan""")

SQL["ways_filtered"] = with_ctes("major_way vertex", """
SELECT way_id, highway_type, name, surface, NULL::VARCHAR AS condition FROM major_way m
WHERE EXISTS (SELECT 1 FROM vertex v WHERE v.way_id = m.way_id AND v.lat BETWEEN 29::DOUBLE AND 31::DOUBLE
              AND v.lon BETWEEN 78::DOUBLE AND 80.5::DOUBLE)""")
ISSUES = """
SELECT way_id, 'name' AS kind, 'Road ' || way_id || ' missing name, using default' AS issue
FROM major_way WHERE raw_name IS NULL
UNION ALL SELECT way_id, 'surface', 'Road ' || way_id || ' missing surface, defaulting to unpaved'
FROM major_way WHERE raw_surface IS NULL
UNION ALL SELECT DISTINCT l_orderkey, 'location', 'Error processing way ' || l_orderkey || ': invalid location'
FROM lineitem WHERE l_partkey NOT IN (SELECT node_id FROM node)"""
SQL["quality_issues"] = with_ctes("major_way node", ISSUES)
SQL["first_issues"] = with_ctes("major_way node", f"SELECT * FROM ({ISSUES}) ORDER BY way_id, kind LIMIT 10")
SQL["network_nodes"] = with_ctes("network_node", "SELECT node_id, lat, lon, 0 AS elevation FROM network_node")
SQL["edges"] = with_ctes("edge", "SELECT * REPLACE (round(distance_m, 3) AS distance_m) FROM edge")
SQL["way_length"] = with_ctes("edge", """
SELECT way_id, count(*) AS edges, round(sum(distance_m), 3) AS distance_m FROM edge GROUP BY way_id""")
SQL["adjacency"] = with_ctes("edge", """
SELECT node_id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree
FROM (SELECT source AS node_id, 1 AS o, 0 AS i FROM edge UNION ALL SELECT target, 0, 1 FROM edge) GROUP BY node_id""")
SQL["adjacency_lists"] = with_ctes("edge", """
SELECT node_id, 0 AS part, coalesce(string_agg(o, ',' ORDER BY edge_id) FILTER (o IS NOT NULL), '') AS out,
       coalesce(string_agg(i, ',' ORDER BY edge_id) FILTER (i IS NOT NULL), '') AS into
FROM (SELECT source AS node_id, edge_id, edge_id || '>' || target AS o, NULL AS i FROM edge
      UNION ALL SELECT target, edge_id, NULL, edge_id || '>' || source FROM edge) GROUP BY node_id""")
SQL["network_stats"] = with_ctes("edge network_node major_way", """
SELECT (SELECT count(*) FROM major_way) AS total_roads, (SELECT count(*) FROM network_node) AS total_nodes,
       (SELECT count(*) FROM edge) AS total_edges,
       (SELECT count(*) FILTER (raw_name IS NULL) + count(*) FILTER (raw_surface IS NULL) FROM major_way)
       AS data_quality_issues""")
SQL["edge_costs"] = with_ctes("any_edge", f"""
SELECT edge_id, round(distance_m, 3) AS shortest,
       round(distance_m * CASE WHEN highway_type IN ('primary', 'secondary') THEN 0.8 WHEN highway_type = 'track' THEN 1.5
             ELSE 1 END::DOUBLE, 3) AS safest,
       round(distance_m * CASE WHEN surface IN {PAVED} THEN 0.7 ELSE 1 END::DOUBLE, 3) AS budget FROM any_edge""")
SQL["social_edges"] = with_ctes("any_edge settlement", f"""
SELECT edge_id, near AS near_settlement, round(distance_m * CASE WHEN near THEN 0.6 ELSE 1 END::DOUBLE, 3) AS social
FROM (SELECT edge_id, any_value(distance_m) AS distance_m,
             bool_or({haversine('(lat1 + lat2) / 2', '(lon1 + lon2) / 2', 's.lat', 's.lon')} < 1000) AS near
      FROM any_edge, settlement s GROUP BY edge_id)""")
SQL["segment_class"] = with_ctes("classified", "SELECT edge_id, construction_type, cost_factor FROM classified")
SQL["construction_stats"] = with_ctes("classified", """
SELECT way_id, round(total, 3) AS total_distance_km, round(new, 2) AS new_construction_km,
       round(upgrade, 2) AS upgrade_existing_km,
       round(CASE WHEN total > 0 THEN upgrade / total * 100 ELSE 0 END, 1) AS utilization_percent,
       round(CASE WHEN total > 0 THEN upgrade * 0.6::DOUBLE / total * 100 ELSE 0 END, 1) AS cost_savings_percent,
       round(cost, 0) AS estimated_cost
FROM (SELECT way_id, sum(distance_m / 1000) AS total,
             sum(CASE WHEN construction_type = 'new_construction' THEN distance_m / 1000 ELSE 0 END) AS new,
             sum(CASE WHEN construction_type = 'new_construction' THEN 0 ELSE distance_m / 1000 END) AS upgrade,
             sum(distance_m / 1000 * CASE WHEN construction_type = 'new_construction' THEN 1000000 ELSE 400000 END) AS cost
      FROM classified GROUP BY way_id)""")
SQL["snap"] = with_ctes("end_all_nodes", """
SELECT route_id, max(CASE WHEN side = 'start' THEN node_id END) AS start_node,
       max(CASE WHEN side = 'end' THEN node_id END) AS end_node,
       round(max(CASE WHEN side = 'start' THEN snap_m END), 3) AS start_snap_m,
       round(max(CASE WHEN side = 'end' THEN snap_m END), 3) AS end_snap_m FROM end_all_nodes GROUP BY route_id""")
STATUS = """
SELECT route_id, start_node, end_node, CASE WHEN start_node IS NULL THEN 'NO_SNAP_POINT_START'
       WHEN end_node IS NULL THEN 'NO_SNAP_POINT_END' WHEN start_node = end_node THEN 'SAME_NODE'
       WHEN NOT EXISTS (SELECT 1 FROM reach WHERE origin = start_node AND node = end_node) THEN 'NO_PATH_EXISTS'
       ELSE 'OK' END AS status FROM ends"""
SQL["route_status"] = with_ctes("ends reach", STATUS)
SQL["path_costs"] = with_ctes("ends reach", """
SELECT route_id, criterion AS variant, round(cost, 3) AS cost
FROM ends JOIN reach ON origin = start_node AND node = end_node WHERE start_node <> end_node""")
SQL["uncontracted_paths"] = SQL["path_costs"]

SQL["two_sided_paths"] = with_ctes("path", """
SELECT route_id, variant, (row_number() OVER (PARTITION BY route_id, variant ORDER BY hop))::INTEGER AS hop, edge_id FROM path""")


def paths_under(criterion: str, edges: str, reads: str) -> str:
    """Least costs of all requests under one criterion; ``edges`` selects edge_id, source, target and the cost w."""
    return with_ctes("ends reach", """
SELECT route_id, criterion AS variant, round(cost, 3) AS cost
FROM ends JOIN reach ON origin = start_node AND node = end_node WHERE start_node <> end_node""",
        criterion_cost=(reads.split(), f"SELECT *, '{criterion}' AS criterion FROM ({edges})", "criterion_cost"),
        origin=(["ends"], f"""
SELECT DISTINCT '{criterion}' AS criterion, start_node AS origin FROM ends
WHERE start_node IS NOT NULL AND end_node IS NOT NULL AND start_node <> end_node""", "origin"))


SQL["budget_paths"] = paths_under("budget", f"""
SELECT edge_id, source, target, distance_m * CASE WHEN surface IN {PAVED} THEN 0.7 ELSE 1 END::DOUBLE AS w FROM edge""", "edge")
SQL["social_paths"] = paths_under("social", f"""
SELECT edge_id, source, target, any_value(distance_m) * CASE WHEN
       bool_or({haversine('(lat1 + lat2) / 2', '(lon1 + lon2) / 2', 's.lat', 's.lon')} < 1000) THEN 0.6 ELSE 1 END::DOUBLE AS w
FROM edge, settlement s GROUP BY edge_id, source, target""", "edge settlement")
SQL["custom_cost_paths"] = paths_under("hours", """
SELECT edge_id, source, target, distance_m / 1000 / CASE WHEN highway_type IN ('primary', 'trunk') THEN 60
       WHEN highway_type = 'secondary' THEN 45 ELSE 25 END::DOUBLE AS w FROM edge""", "edge")
SQL["contracted_paths"] = paths_under("shortest", """
SELECT edge_id, source, target, distance_m AS w FROM edge
UNION ALL SELECT edge_id || 'r', target, source, distance_m FROM edge""", "edge")
SQL["straight_samples"] = with_ctes("sample_all_nodes", """
SELECT route_id, seq, round(coalesce(n_lat, lat), 9) AS lat, round(coalesce(n_lon, lon), 9) AS lon,
       node_id IS NOT NULL AS on_road, node_id FROM sample_all_nodes""")
SQL["hybrid_route"] = with_ctes("sample_all_nodes", f"""
SELECT route_id, variant, name, round(km * f, 6) AS total_distance_km, round(km * f, 2) AS new_construction_km,
       round(round(km * f * 1000000, 2), 0) AS estimated_cost
FROM (SELECT route_id, sum(CASE WHEN lat2 IS NULL THEN 0 ELSE {haversine('lat', 'lon', 'lat2', 'lon2')} END ORDER BY seq)
             / 1000 AS km, bool_or(on_road) AS any_road
      FROM (SELECT route_id, seq, on_road, lat, lon, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2
            FROM (SELECT route_id, seq, node_id IS NOT NULL AS on_road, coalesce(n_lat, lat) AS lat,
                         coalesce(n_lon, lon) AS lon FROM sample_all_nodes)
            WINDOW w AS (PARTITION BY route_id ORDER BY seq)) GROUP BY route_id),
     (VALUES ('shortest', 'Hybrid Route (OSM + Direct)', 1.0::DOUBLE), ('safest', 'Safest Hybrid Route', 1.1::DOUBLE))
     v(variant, name, f)
WHERE any_road""")

SQL["thinned_rivers"] = with_ctes("river_vertex", """
SELECT river_id, seq, lat, lon FROM (SELECT *, count(*) OVER (PARTITION BY river_id) AS n FROM river_vertex)
WHERE n <= 25 OR seq = 0 OR seq = n - 1 OR seq IN (SELECT unnest(range(1, 24)) * (n // 24))""")

LINES = O.joined(O.kml_line("round(lon, 6)", "round(lat, 6)", "trunc(design)::INTEGER"), "idx")
TRACK = O.joined(O.gpx_line("round(lon, 6)", "round(lat, 6)", "trunc(design)::INTEGER"), "idx")
NAME = "CASE variant WHEN 'safest' THEN 'Safest Route' ELSE 'Shortest Route' END"
HEAD = """'<?xml version="1.0" encoding="UTF-8"?>
<gpx version="1.1" creator="roadplan">
'"""
SQL["survey_documents"] = with_ctes("survey earthwork", f"""
SELECT route_id, variant, md5({O.kml(NAME, "'Road alignment for construction - Total Cut: ' || trunc(cut)::BIGINT || ' m³, Total Fill: ' || trunc(fill)::BIGINT || ' m³'", 'lines', 'routeLine', "''")}) AS kml_md5,
       md5({O.gpx(HEAD, NAME, 'track')}) AS gpx_md5, total_waypoints::INTEGER AS vertices, trunc(cut)::BIGINT AS cut,
       first_lat
FROM earthwork JOIN (SELECT route_id, variant, {LINES} AS lines, {TRACK} AS track,
                            max(CASE WHEN idx = 0 THEN round(lat, 6) END) AS first_lat
                     FROM survey GROUP BY route_id, variant) USING (route_id, variant)""")

POINT = (O.plain("lon"), O.plain("lat"), "elevation")
NOTE = f"'Distance: ' || {O.plain('distance_km')} || ' km'"
META = f"""'<?xml version="1.0" encoding="UTF-8"?>
<gpx version="1.1" creator="roadplan" xmlns="http://www.topografix.com/GPX/1/1">
  <metadata>
    <name>' || name || '</name>
    <desc>' || {NOTE} || '</desc>
  </metadata>
'"""
SQL["waypoint_documents"] = with_ctes("export wp", f"""
SELECT route_id, variant,
       {O.kml('name', 'description', 'lines', 'routeStyle', f"'      <description>' || {NOTE} || '</description>' || chr(10)")} AS kml,
       {O.gpx(META, 'name', 'track')} AS gpx,
       '{{"type":"FeatureCollection","features":[{{"type":"Feature","geometry":{{"type":"LineString","coordinates":['
       || pairs || ']}},"properties":{{"name":"' || name || '","description":"' || description || '","distance_km":'
       || {O.plain('distance_km')} || ',"elevation_gain_m":' || elevation_gain_m || ',"estimated_cost":'
       || {O.plain('estimated_cost')} || ',"risk_score":' || terrain_risk || '}}}}]}}' AS geojson,
       replace(name, ' ', '_') || '_route.kml' AS kml_file, replace(name, ' ', '_') || '_route.gpx' AS gpx_file,
       replace(name, ' ', '_') || '_route.geojson' AS geojson_file
FROM export JOIN (SELECT route_id, variant, {O.joined(O.kml_line(*POINT), 'seq')} AS lines,
                         {O.joined(O.gpx_line(*POINT), 'seq')} AS track,
                         {O.joined(f"'[' || {POINT[0]} || ',' || {POINT[1]} || ',' || elevation || ']'", 'seq', "','")} AS pairs
                  FROM wp GROUP BY route_id, variant) USING (route_id, variant)""")

FEATURES = """
SELECT edge_id, to_json({'type': 'Feature',
       'geometry': {'type': 'LineString', 'coordinates': [[lon1, lat1], [lon2, lat2]]},
       'properties': {'id': edge_id, 'name': name, 'highway_type': highway_type, 'surface': surface,
                      'distance_m': round(distance_m, 3)}})::VARCHAR AS feature
FROM edge ORDER BY way_id, pos LIMIT 500"""
SQL["road_features"] = with_ctes("edge", FEATURES)
SQL["road_collection"] = with_ctes("edge", f"""
SELECT '{{"type":"FeatureCollection","features":[' || string_agg(feature, ',' ORDER BY edge_id) || ']}}' AS document
FROM ({FEATURES})""")
SQL["layer_config"] = with_ctes("terrain", f"""
SELECT route_id, variant, {NAME} AS name, CASE variant WHEN 'safest' THEN '#10b981' ELSE '#3b82f6' END AS color FROM terrain""")
SQL["explanations"] = with_ctes("export", """
SELECT route_id, variant, 'You are an AI assistant for rural infrastructure planning in Uttarakhand, India.

Analyze this route and provide a brief explanation:

Route: ' || name || '
Distance: ' || distance_km || ' km
Elevation Gain: ' || elevation_gain_m || ' m
Risk Score: ' || terrain_risk || '/100
Terrain Risk: 50/100
Flood Risk: 50/100

Context: ' || context || '

Provide a 2-3 sentence explanation of why this route was recommended, considering terrain, safety, and construction feasibility.' AS prompt,
       'This route offers a balance between ' || lower(name)
       || ' characteristics and practical construction considerations for the Uttarkashi region.' AS fallback
FROM export""")
SQL["display_text"] = with_ctes("export earthwork", f"""
SELECT route_id, variant, CASE WHEN terrain_risk > 60 THEN 'high' WHEN terrain_risk > 40 THEN 'medium' ELSE 'low' END AS band,
       CASE WHEN terrain_risk > 60 THEN terrain_risk - 60 ELSE 50 END AS shown_risk,
       {O.fixed('estimated_cost / 100000', 1)} || 'Cr' AS cost, {O.volume('trunc(e.cut)::BIGINT')} AS cut,
       {O.volume('trunc(e.fill)::BIGINT')} AS fill, CASE balance_status WHEN 'balanced' THEN 'Balanced'
       WHEN 'excess_cut' THEN 'Excess Cut' ELSE 'Excess Fill' END AS status
FROM export JOIN earthwork e USING (route_id, variant)""")
SQL["bridge_estimates"] = with_ctes("length", f"SELECT route_id, variant, {O.bridges('km')}::INTEGER AS bridges FROM length")
SQL["request_intake"] = with_ctes("request", """
SELECT route_id, CASE WHEN route_id % 7 = 0 OR route_id % 11 = 0 THEN 30.7268::DOUBLE ELSE start_lat END AS start_lat,
       CASE WHEN route_id % 7 = 0 THEN 78.4354::DOUBLE ELSE start_lon END AS start_lon,
       30.9993::DOUBLE AS end_lat, 78.9394::DOUBLE AS end_lon, context,
       CASE WHEN route_id % 7 <> 0 AND route_id % 11 = 0 THEN 'not a number: start_lat' END AS reason FROM request""")
SQL["region_guard"] = with_ctes("request", """
SELECT route_id, start_lat + 0.5::DOUBLE BETWEEN 28.5::DOUBLE AND 31.6::DOUBLE
       AND start_lon BETWEEN 77.4::DOUBLE AND 81.1::DOUBLE AND end_lat - 0.5::DOUBLE BETWEEN 28.5::DOUBLE AND 31.6::DOUBLE
       AND end_lon BETWEEN 77.4::DOUBLE AND 81.1::DOUBLE AS inside FROM request""")
SQL["rainfall_lines"] = """
SELECT CASE r_name WHEN 'MIDDLE EAST' THEN r_name ELSE r_name[1] || lower(r_name[2:]) END AS district,
       (900 + 300 * r_regionkey)::DOUBLE AS annual_mm FROM region WHERE r_regionkey % 2 = 1"""
SQL["river_features"] = with_ctes("river_vertex", """
SELECT (dense_rank() OVER (ORDER BY river_id) - 1)::BIGINT AS river_id, name, 'river' AS waterway, (row_number() OVER (PARTITION BY river_id ORDER BY seq) - 1)::INTEGER AS seq, lat, lon
FROM river_vertex""")
SQL["settlement_features"] = with_ctes("settlement river_vertex", """
SELECT (SELECT count(DISTINCT river_id) FROM river_vertex) + row_number() OVER (ORDER BY feature_seq) - 1 AS feature_seq,
       name, place, lat, lon, population FROM settlement""")
SQL["source_choice"] = f"""
SELECT 'whole' AS source, 'file' AS used, (SELECT count(*) FROM supplier) AS places
UNION ALL SELECT unnest(['broken', 'missing']), 'default', {len(defaults.SETTLEMENTS)}"""
SQL["builtin_tourism"] = with_ctes("near_tourism", """
SELECT route_id, variant, rank, name, score, distance_from_route_km
FROM (SELECT *, row_number() OVER (PARTITION BY route_id, variant ORDER BY score DESC, wp_seq, feature_seq) AS rank
      FROM near_tourism) WHERE rank <= 3""", tourism=([], "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{name}', {lat}::DOUBLE, {lon}::DOUBLE, {score})"
    for i, (name, lat, lon, _, score, _) in enumerate(defaults.TOURISM_SPOTS)
) + ") AS t(feature_seq, name, lat, lon, score)", "tourism"))
SQL["osm_ways"] = with_ctes("way vertex", """
SELECT way_id, pos, ref, lat, lon, highway_type AS highway, raw_surface AS surface, raw_name AS name
FROM vertex JOIN way USING (way_id)""")
SQL["network_snapshot"] = with_ctes("edge network_node major_way", """
SELECT highway_type, count(*) AS edges, round(sum(distance_m), 1) AS distance_m,
       (SELECT count(*) FROM major_way) AS total_roads_parsed, (SELECT count(*) FROM network_node) AS total_nodes,
       (SELECT count(*) FROM edge) AS total_edges,
       (SELECT count(*) FILTER (raw_name IS NULL) + count(*) FILTER (raw_surface IS NULL) FROM major_way)
       AS data_quality_issues, true AS valid FROM edge GROUP BY highway_type""")
SQL["streamed_requests"] = with_ctes("request variant", """
SELECT route_id, variant, k::INTEGER AS waypoints, NULL AS reason FROM request, variant
WHERE route_id % 11 <> 0 AND route_id % 13 <> 0
UNION ALL SELECT route_id, NULL, NULL, CASE WHEN route_id % 11 = 0 THEN 'not JSON' ELSE 'outside the permitted area' END
FROM request WHERE route_id % 11 = 0 OR route_id % 13 = 0""")
SQL["response_fields"] = f"""
WITH plans AS ({SQL["route_plan"]}), texts AS ({SQL["field_instructions"]}),
near AS ({SQL["settlements_near"]}), spots AS ({SQL["tourism_near"]}), bridge AS ({SQL["river_crossings"]})
SELECT p.route_id, 'mathematical' AS routing_method, p.id, p.name, p.description, p.priority, p.distance_km,
       p.estimated_cost AS estimated_cost_usd, p.elevation_gain_m, p.construction_difficulty, p.estimated_days, p.risk_score,
       p.bridges_required, p.social_impact_score, p.terrain_risk, p.flood_risk, p.seasonal_risk, p.existing_road_km,
       p.new_construction_km, p.utilization_percent, p.total_waypoints, p.total_length_m, p.max_gradient_percent,
       p.avg_gradient_percent, p.total_cut_m3, p.total_fill_m3, p.balance_status, 5.5::DOUBLE AS road_width_m,
       t.earthwork AS earthwork_text, t.surveying, t.leveling, t.gradient_control,
       'DEM,Rainfall,Rivers,Settlements,Tourism,Roads' AS sources_text, coalesce(s.n, '') AS settlements_text,
       coalesce(v.n, '') AS tourism_text, coalesce(b.n, '') AS rivers_text
FROM plans p JOIN texts t USING (route_id, variant)
LEFT JOIN (SELECT route_id, variant, string_agg(name || '|' || coalesce(population::VARCHAR, 'Unknown'), ';' ORDER BY rank)
                  AS n FROM near WHERE rank <= 10 GROUP BY ALL) s USING (route_id, variant)
LEFT JOIN (SELECT route_id, variant, string_agg(name || '|' || score, ';' ORDER BY rank) AS n FROM spots GROUP BY ALL) v
     USING (route_id, variant)
LEFT JOIN (SELECT route_id, variant, string_agg(river_name, ';' ORDER BY seg, river_id) AS n
           FROM (SELECT *, row_number() OVER (PARTITION BY route_id, variant ORDER BY seg, river_id) AS nth FROM bridge)
           WHERE nth <= 5 GROUP BY ALL) b USING (route_id, variant)"""
SQL["response_sizes"] = with_ctes("wp crossing near_settlement near_tourism", """
SELECT w.route_id, w.variant, 'route-1' AS recommended, least(10, w.n)::INTEGER AS waypoints,
       least(5, c.n)::INTEGER AS river_crossings, least(10, coalesce(s.n, 0))::INTEGER AS nearby_settlements,
       least(3, coalesce(t.n, 0))::INTEGER AS tourism_spots, 10 AS detailed_waypoints
FROM (SELECT route_id, variant, count(*) AS n FROM wp GROUP BY ALL) w
LEFT JOIN (SELECT route_id, variant, count(*) AS n FROM crossing GROUP BY ALL) c USING (route_id, variant)
LEFT JOIN (SELECT route_id, variant, count(*) AS n FROM near_settlement GROUP BY ALL) s USING (route_id, variant)
LEFT JOIN (SELECT route_id, variant, count(*) AS n FROM near_tourism GROUP BY ALL) t USING (route_id, variant)""")

SQL["route_from_path"] = with_ctes("path_stats wp", """
SELECT route_id, variant, CASE variant WHEN 'safest' THEN 'Safest Route' ELSE 'Shortest Route' END AS name,
       (SELECT count(*) FROM wp w WHERE w.route_id = p.route_id AND w.variant = p.variant)::INTEGER AS waypoint_count,
       round(total_distance_km, 6) AS total_distance_km, 0::DOUBLE AS new_construction_km,
       round(total_distance_km, 2) AS upgrade_existing_km, 100::DOUBLE AS utilization_percent,
       60::DOUBLE AS cost_savings_percent, round(estimated_cost, 0) AS estimated_cost FROM path_stats p""", wp=O.NETWORK_WP)
SQL["network_plan"] = with_ctes("path_stats wp terrain_raw site bridge_count social utilization earthwork", """
SELECT *, trunc((terrain_risk + flood_risk + rainfall_risk) / 3)::INTEGER AS risk_score
FROM (SELECT p.route_id, p.variant, CASE p.variant WHEN 'safest' THEN 'Safest Route' ELSE 'Shortest Route' END AS name,
             round(p.total_distance_km, 6) AS total_distance_km, 0::DOUBLE AS new_construction_km,
             round(p.total_distance_km, 2) AS upgrade_existing_km, 100::DOUBLE AS utilization_percent,
             60::DOUBLE AS cost_savings_percent, p.estimated_cost, w.n::INTEGER AS waypoint_count, t.elevation_gain_m,
             trunc(p.total_distance_km * 2)::BIGINT AS estimated_days,
             CASE p.variant WHEN 'safest' THEN greatest(20, t.terrain - 15) ELSE t.terrain END AS terrain_risk,
             CASE p.variant WHEN 'safest' THEN greatest(15, flood_base_risk - 15) ELSE flood_base_risk END AS flood_risk,
             rainfall_risk, bridges_required, settlements, social_impact_score,
             u.utilization_percent AS corridor_percent, total_waypoints, trunc(cut)::BIGINT AS total_cut_m3,
             trunc(fill)::BIGINT AS total_fill_m3, balance_status
      FROM path_stats p JOIN terrain_raw t USING (route_id, variant) JOIN site USING (route_id)
      JOIN (SELECT route_id, variant, count(*) AS n FROM wp GROUP BY ALL) w USING (route_id, variant)
      LEFT JOIN bridge_count USING (route_id, variant) JOIN social USING (route_id, variant)
      JOIN utilization u USING (route_id, variant) JOIN earthwork USING (route_id, variant))""", wp=O.NETWORK_WP)
SQL["corridor_table"] = SQL["road_utilization"]
ROUTING = f"""
SELECT route_id, variant, CASE WHEN status = 'OK' THEN 'osm_network'
       WHEN starts_with(status, 'NO_SNAP') AND on_road THEN 'hybrid' ELSE 'mathematical' END AS routing_method
FROM ({STATUS}) JOIN (SELECT route_id, bool_or(node_id IS NOT NULL) AS on_road FROM sample_network GROUP BY route_id)
     USING (route_id), (VALUES ('shortest'), ('safest')) v(variant)"""
SQL["routing_method"] = with_ctes("ends reach sample_network", ROUTING)
CURVE_WP = (O.CTES["wp"][0], O.CTES["wp"][1], "curve_wp")
ANY_WP = (["curve_wp", "method", "sample_network", "road_wp"], f"""
SELECT w.route_id, w.variant, w.seq, w.lat, w.lon, w.elevation
FROM curve_wp w JOIN method m ON m.route_id = w.route_id AND m.variant = w.variant AND m.routing_method = 'mathematical'
UNION ALL SELECT route_id, variant, seq, lat, lon, elevation FROM road_wp
UNION ALL SELECT route_id, variant, seq, lat, lon, {elevation('lat', 'lon')}
FROM (SELECT s.route_id, m.variant, s.seq, coalesce(s.n_lat, s.lat) AS lat, coalesce(s.n_lon, s.lon) AS lon
      FROM sample_network s JOIN method m ON m.route_id = s.route_id AND m.routing_method = 'hybrid')""", "wp AS MATERIALIZED")
ROAD_STATS = (["path_stats", "wp", "method"], f"""
SELECT route_id, variant, CASE variant WHEN 'safest' THEN 'Safest Route' ELSE 'Shortest Route' END AS name,
       total_distance_km, 0::DOUBLE AS new_construction_km, round(total_distance_km, 2) AS existing_road_km,
       100::DOUBLE AS utilization_percent, 60::DOUBLE AS cost_savings_percent, estimated_cost FROM path_stats
UNION ALL
SELECT route_id, variant, CASE variant WHEN 'safest' THEN 'Safest Hybrid Route' ELSE 'Hybrid Route (OSM + Direct)' END,
       km, round(km, 2), 0, 0, 0, round(km * 1000000, 2)
FROM (SELECT route_id, variant, sum({haversine('lat', 'lon', 'lat2', 'lon2')} ORDER BY seq) / 1000
             * CASE variant WHEN 'safest' THEN 1.1::DOUBLE ELSE 1 END AS km
      FROM (SELECT w.*, lead(lat) OVER n AS lat2, lead(lon) OVER n AS lon2 FROM wp w
            JOIN method m ON m.route_id = w.route_id AND m.variant = w.variant AND m.routing_method = 'hybrid'
            WINDOW n AS (PARTITION BY w.route_id, w.variant ORDER BY seq))
      WHERE lat2 IS NOT NULL GROUP BY route_id, variant)""", "road_stats")
SURVEYED = """total_waypoints, total_length_m, max_gradient_percent, avg_gradient_percent, trunc(cut)::BIGINT AS total_cut_m3,
       trunc(fill)::BIGINT AS total_fill_m3, trunc(cut - fill)::BIGINT AS balance_m3, balance_status"""
SQL["planned_routes"] = with_ctes("plan method road_stats terrain_raw site bridge_count social earthwork", f"""
SELECT route_id, variant, routing_method, CASE variant WHEN 'safest' THEN 'route-2' ELSE 'route-1' END AS id,
       CASE variant WHEN 'safest' THEN 'Safest Route' ELSE 'Shortest Route' END AS name, round(round(km, 2), 6) AS distance_km,
       new_construction_km, existing_road_km, utilization_percent, cost_savings_percent,
       round(round((new_construction_km * 35000 + existing_road_km * 5000) * (1 + terrain_risk / 100)
             + bridges_required * 25000, 2), 0) AS estimated_cost,
       round_even(km * 15 * (1 + terrain_risk / 300) + bridges_required * 30, 0)::BIGINT AS estimated_days,
       elevation_gain_m, terrain_risk, flood_risk, seasonal_risk AS rainfall_risk, risk_score, bridges_required, settlements,
       social_impact_score, {SURVEYED}
FROM plan JOIN method USING (route_id, variant) WHERE routing_method = 'mathematical'
UNION ALL
SELECT route_id, variant, routing_method, variant, name, round(total_distance_km, 6), new_construction_km, existing_road_km,
       utilization_percent, cost_savings_percent, round(estimated_cost, 0), trunc(total_distance_km * 2)::BIGINT,
       elevation_gain_m, terrain, flood, rainfall_risk, trunc((terrain + flood + rainfall_risk) / 3)::INTEGER,
       coalesce(bridges_required, 0), settlements, social_impact_score, {SURVEYED}
FROM (SELECT r.*, routing_method, elevation_gain_m, bridges_required, settlements, social_impact_score, rainfall_risk,
             e.* EXCLUDE (route_id, variant),
             CASE r.variant WHEN 'safest' THEN greatest(20, t.terrain - 15) ELSE t.terrain END AS terrain,
             CASE r.variant WHEN 'safest' THEN greatest(15, flood_base_risk - 15) ELSE flood_base_risk END AS flood
      FROM road_stats r JOIN method USING (route_id, variant) JOIN terrain_raw t USING (route_id, variant)
      JOIN site USING (route_id) LEFT JOIN bridge_count USING (route_id, variant) JOIN social USING (route_id, variant)
      JOIN earthwork e USING (route_id, variant))""", wp=ANY_WP, curve_wp=CURVE_WP, road_wp=O.WHOLE_WP,
    method=(["ends", "reach", "sample_network"], ROUTING, "method AS MATERIALIZED"), road_stats=ROAD_STATS)
SQL["simplified_rivers"] = with_ctes("river_vertex", f"""
SELECT * FROM (WITH RECURSIVE span(line_id, lo, hi) AS (
  SELECT river_id, min(seq), max(seq) FROM river_vertex GROUP BY river_id
  UNION ALL
  SELECT line_id, unnest([lo, -far.back]), unnest([-far.back, hi])
  FROM (SELECT s.line_id, s.lo, s.hi, max({{'d': d, 'back': -p_seq}}) AS far
        FROM (SELECT s.line_id, s.lo, s.hi, p.seq AS p_seq,
                     sqrt((b.lon - a.lon) * (b.lon - a.lon) + (b.lat - a.lat) * (b.lat - a.lat)) AS len2,
                     ((p.lon - a.lon) * (b.lon - a.lon) + (p.lat - a.lat) * (b.lat - a.lat)) / (len2 * len2) AS u,
                     CASE WHEN len2 = 0 OR u < 0 THEN {planar('a.lat', 'a.lon', 'p.lat', 'p.lon')}
                          WHEN u > 1 THEN {planar('b.lat', 'b.lon', 'p.lat', 'p.lon')}
                          ELSE {planar('(a.lat + u * (b.lat - a.lat))', '(a.lon + u * (b.lon - a.lon))', 'p.lat', 'p.lon')}
                     END AS d
              FROM span s JOIN river_vertex p ON p.river_id = s.line_id AND p.seq > s.lo AND p.seq < s.hi
              JOIN river_vertex a ON a.river_id = s.line_id AND a.seq = s.lo
              JOIN river_vertex b ON b.river_id = s.line_id AND b.seq = s.hi) s
        GROUP BY s.line_id, s.lo, s.hi) WHERE far.d > 0.02::DOUBLE)
SELECT DISTINCT line_id, unnest([lo, hi]) AS seq FROM span)""")
