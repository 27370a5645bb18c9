"""Shared SQL text: scalar formulas and named common table expressions."""

# Both ends of the major routes as (lat, lon), and the half-width around them in degrees.
CORRIDOR_ENDS = [(30.1, 78.3), (31.0, 78.9), (30.5, 78.5), (30.8, 78.8)]
CORRIDOR_DEGREES = 0.05


def spread(key: str, factor: int, modulus: int, origin: float) -> str:
    return f"{origin}::DOUBLE + ({key} * {factor} % {modulus}) / 1000"


def elevation(lat: str, lon: str) -> str:
    return (
        f"(CASE WHEN {lat} BETWEEN 28.6::DOUBLE AND 31.5::DOUBLE AND {lon} BETWEEN 77.5::DOUBLE AND 81.0::DOUBLE "
        f"THEN greatest(300, least(4000, trunc(300 + ({lat} - 28.6::DOUBLE) * 900 + ({lon} - 77.5::DOUBLE) * 100 "
        f"+ (trunc(({lat} * {lon} * 1000) % 400) - 200)))) ELSE 1500 END)::INTEGER"
    )


def planar(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return f"sqrt(({lat2} - {lat1}) * ({lat2} - {lat1}) + ({lon2} - {lon1}) * ({lon2} - {lon1}))"


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (
        f"(power(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) "
        f"* power(sin(radians({lon2} - {lon1}) / 2), 2))"
    )
    return f"(2 * 6371000::DOUBLE * atan2(sqrt({a}), sqrt(1 - {a})))"


def near_corridor(lat: str, lon: str) -> str:
    return "(" + " OR ".join(
        f"(abs({lat} - {a}::DOUBLE) < {CORRIDOR_DEGREES}::DOUBLE AND abs({lon} - {b}::DOUBLE) < {CORRIDOR_DEGREES}::DOUBLE)"
        for a, b in CORRIDOR_ENDS
    ) + ")"


def flood_base(elev: str) -> str:
    return (
        f"(CASE WHEN {elev} < 800 THEN 75 WHEN {elev} < 1200 THEN 55 WHEN {elev} < 1800 THEN 35 "
        f"WHEN {elev} < 2500 THEN 25 ELSE 15 END)"
    )


def bridges(km: str) -> str:
    return (
        f"least(5, CASE WHEN {km} < 15 THEN 1 WHEN {km} < 40 THEN 2 ELSE greatest(2, trunc({km} / 20)::INTEGER) END)"
    )


PAVED = "('paved', 'asphalt', 'concrete')"
MAJOR = (
    "('motorway', 'trunk', 'primary', 'secondary', 'motorway_link', 'trunk_link', 'primary_link', 'secondary_link')"
)

# name -> (names it reads, text, heading)
CTES: dict[str, tuple[list[str], str, str]] = {}


def cte(name: str, reads: str, text: str, heading: str | None = None) -> None:
    CTES[name] = (reads.split(), text, heading or name)


def with_ctes(reads: str, select: str, **instead: tuple[list[str], str, str]) -> str:
    """``select`` preceded by the named expressions and all they read, in order.

    ``instead`` replaces expressions by name.
    """
    known = CTES | instead
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for needed in known[name][0]:
            visit(needed)
        order.append(name)

    for name in reads.split():
        visit(name)
    recursive = "RECURSIVE " if any(known[n][2] != n for n in order) else ""
    head = lambda name: known[name][2] if known[name][2].endswith("MATERIALIZED") else f"{known[name][2]} AS"
    body = ",\n".join(f"{head(n)} ({known[n][1]})" for n in order)
    return f"WITH {recursive}{body}\n{select}"


cte("request", "", f"""
SELECT c_custkey AS route_id,
       {spread('c_custkey', 7919, 2900, 28.6)} AS start_lat, {spread('c_custkey', 104729, 3500, 77.5)} AS start_lon,
       {spread('c_custkey', 6101, 2900, 28.6)} AS end_lat, {spread('c_custkey', 50021, 3500, 77.5)} AS end_lon,
       r_name AS district, c_mktsegment AS context
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")

cte("node", "", f"""
SELECT p_partkey AS node_id, {spread('p_partkey', 6151, 2900, 28.6)} AS lat,
       {spread('p_partkey', 15485863, 3500, 77.5)} AS lon FROM part""")

cte("settlement", "", f"""
SELECT s_suppkey AS feature_seq, s_name AS name, CASE WHEN s_suppkey % 5 = 0 THEN 'town' ELSE 'village' END AS place,
       {spread('s_suppkey', 4091, 2900, 28.6)} AS lat, {spread('s_suppkey', 7013, 3500, 77.5)} AS lon,
       CASE WHEN s_acctbal >= 0 THEN floor(s_acctbal)::INTEGER END AS population FROM supplier""")

cte("tourism", "", f"""
SELECT n_nationkey AS feature_seq, n_name AS name, {spread('n_nationkey', 1301, 2900, 28.6)} AS lat,
       {spread('n_nationkey', 1709, 3500, 77.5)} AS lon, 5 + n_nationkey % 16 AS score FROM nation""")

cte("river_vertex", "", """
SELECT river_id, 'River ' || river_id AS name, seq,
       28.6::DOUBLE + ((river_id * 577) % 2600 + abs((seq * 37) % 600 - 300)) / 1000 AS lat,
       77.5::DOUBLE + ((river_id * 911) % 3200 + abs((seq * 53) % 600 - 300)) / 1000 AS lon
FROM (SELECT p_partkey % 50 AS river_id, p_partkey // 50 AS seq FROM part)""")

cte("river_seg", "river_vertex", """
SELECT a.river_id, a.name AS river_name, a.seq AS river_seg, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2
FROM river_vertex a JOIN river_vertex b ON a.river_id = b.river_id AND b.seq = a.seq + 1""")

cte("variant", "", """
SELECT * FROM (VALUES ('shortest', 6, 0.08::DOUBLE), ('safest', 8, 0.12::DOUBLE)) v(variant, k, f)""")

cte("bend", "variant", """
SELECT variant, i::INTEGER AS seq, t,
       CASE variant WHEN 'safest' THEN sin(t * pi() * 2) * f * 0.5::DOUBLE + sin(t * pi() * 3) * f * 0.3::DOUBLE
            ELSE sin(t * pi()) * f + sin(t * pi() * 2) * f * 0.3::DOUBLE END AS c
FROM (SELECT variant, f, i, (i * (2 * k - 1) // (k - 1))::DOUBLE / (2 * k - 1) AS t
      FROM variant, unnest(range(0, k)) r(i))""")

cte("wp", "request bend", f"""
SELECT route_id, variant, seq, round(lat, 5) AS lat, round(lon, 5) AS lon, {elevation('lat', 'lon')} AS elevation
FROM (SELECT route_id, variant, seq, start_lat + (end_lat - start_lat) * t + c * (end_lon - start_lon) AS lat,
             start_lon + (end_lon - start_lon) * t - c * (end_lat - start_lat) AS lon FROM request, bend)""")

cte("leg", "wp", f"""
SELECT route_id, variant, seq AS seg, lat AS lat1, lon AS lon1, lat2, lon2, elevation AS e1, e2,
       {planar('lat', 'lon', 'lat2', 'lon2')} * 111 AS km
FROM (SELECT *, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2, lead(elevation) OVER w AS e2
      FROM wp WINDOW w AS (PARTITION BY route_id, variant ORDER BY seq)) WHERE lat2 IS NOT NULL""")

cte("terrain_raw", "leg", """
SELECT route_id, variant,
       least(100, trunc(30 + max(abs(e2 - e1)) / 50 + avg(abs(e2 - e1)) / 20))::INTEGER AS terrain,
       greatest(max(e1), max(e2)) - least(min(e1), min(e2)) AS elevation_gain_m
FROM leg GROUP BY ALL""")

cte("terrain", "terrain_raw", """
SELECT a.route_id, a.variant, a.elevation_gain_m,
       CASE WHEN a.variant = 'safest' AND a.terrain >= b.terrain THEN greatest(20, b.terrain - 10) ELSE a.terrain END
       AS terrain_risk
FROM terrain_raw a JOIN terrain_raw b ON a.route_id = b.route_id AND b.variant = 'shortest'""")

cte("site", "request river_vertex", f"""
SELECT route_id, district, elev, river_km,
       least(100, base + CASE WHEN elev > 2500 THEN 15 WHEN elev > 2000 THEN 10 ELSE 0 END)::INTEGER AS rainfall_risk,
       least(100, {flood_base('elev')} + CASE WHEN river_km < 1 THEN 20 WHEN river_km < 3 THEN 10 ELSE 0 END)::INTEGER
       AS flood_base_risk
FROM (SELECT m.route_id, m.district, {elevation('m.lat', 'm.lon')} AS elev,
             least(100, trunc(20 + coalesce(900 + 300 * r_regionkey, 1500)::DOUBLE / 40)) AS base, river_km
      FROM (SELECT route_id, district, (start_lat + end_lat) / 2 AS lat, (start_lon + end_lon) / 2 AS lon FROM request) m
      LEFT JOIN region ON r_name = m.district
      LEFT JOIN (SELECT route_id, min({planar('q.lat', 'q.lon', 'v.lat', 'v.lon')} * 111) AS river_km
                 FROM (SELECT route_id, (start_lat + end_lat) / 2 AS lat, (start_lon + end_lon) / 2 AS lon FROM request) q,
                      river_vertex v GROUP BY route_id) d ON d.route_id = m.route_id)""")

cte("meet", "leg river_seg", """
SELECT route_id, variant, seg, river_id, river_name, river_seg, lat1 + t * dy AS lat, lon1 + t * dx AS lon
FROM (SELECT *, (gx * qy - gy * qx) / den AS t, (gx * dy - gy * dx) / den AS u
      FROM (SELECT *, dx * qy - dy * qx AS den
            FROM (SELECT l.route_id, l.variant, l.seg, l.lat1, l.lon1, r.river_id, r.river_name, r.river_seg,
                         l.lon2 - l.lon1 AS dx, l.lat2 - l.lat1 AS dy, r.lon2 - r.lon1 AS qx, r.lat2 - r.lat1 AS qy,
                         r.lon1 - l.lon1 AS gx, r.lat1 - l.lat1 AS gy
                  FROM leg l JOIN river_seg r
                    ON least(l.lat1, l.lat2) <= greatest(r.lat1, r.lat2) + 1e-6::DOUBLE
                   AND least(r.lat1, r.lat2) <= greatest(l.lat1, l.lat2) + 1e-6::DOUBLE
                   AND least(l.lon1, l.lon2) <= greatest(r.lon1, r.lon2) + 1e-6::DOUBLE
                   AND least(r.lon1, r.lon2) <= greatest(l.lon1, l.lon2) + 1e-6::DOUBLE))
      WHERE abs(den) >= 1e-10::DOUBLE)
WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1""")

cte("raw_crossing", "meet", """
SELECT route_id, variant, seg, river_id, river_name, round(lat, 5) AS lat, round(lon, 5) AS lon
FROM (SELECT *, row_number() OVER (PARTITION BY route_id, variant, seg, river_id ORDER BY river_seg) AS rn FROM meet)
WHERE rn = 1""")

cte("kept_crossing", "raw_crossing", """
SELECT route_id, variant, river_name, k.seg, k.river_id, k.lat, k.lon
FROM (SELECT route_id, variant, river_name, unnest(kept) AS k
      FROM (SELECT route_id, variant, river_name, list_reduce(list(
                   [{'seg': seg, 'river_id': river_id, 'lat': lat, 'lon': lon}] ORDER BY seg, river_id),
                   lambda acc, x: CASE WHEN len(list_filter(acc, lambda a:
                        abs(a.lat - x[1].lat) < 0.001::DOUBLE AND abs(a.lon - x[1].lon) < 0.001::DOUBLE)) > 0
                        THEN acc ELSE list_concat(acc, x) END) AS kept
            FROM raw_crossing GROUP BY route_id, variant, river_name))""")

cte("length", "leg wp", """
SELECT route_id, variant, km, points FROM (SELECT route_id, variant, sum(km ORDER BY seg) AS km FROM leg GROUP BY ALL)
JOIN (SELECT route_id, variant, count(*) AS points FROM wp GROUP BY ALL) USING (route_id, variant)""")

cte("guess", "length kept_crossing", f"""
SELECT route_id, variant, points, {bridges('km')} AS bridges FROM length
WHERE NOT EXISTS (SELECT 1 FROM kept_crossing k WHERE k.route_id = length.route_id AND k.variant = length.variant)""")

cte("crossing", "kept_crossing guess wp", """
SELECT route_id, variant, seg::INTEGER AS seg, river_id, river_name, lat, lon, 50 AS estimated_span_m FROM kept_crossing
UNION ALL
SELECT g.route_id, g.variant, i::INTEGER AS seg, NULL AS river_id, 'River/Stream (estimated)', w.lat, w.lon, 45
FROM (SELECT *, unnest(range(1, bridges + 1)) AS i FROM guess) g
JOIN wp w ON w.route_id = g.route_id AND w.variant = g.variant
 AND w.seq = least(i * (points // (bridges + 1)), points - 1)""")

cte("bridge_count", "crossing", "SELECT route_id, variant, count(*) AS bridges_required FROM crossing GROUP BY ALL")

cte("near_settlement", "wp settlement", f"""
SELECT route_id, variant, name, type, lat, lon, km AS distance_from_route_km, population, wp_seq, feature_seq
FROM (SELECT *, row_number() OVER (PARTITION BY route_id, variant, name ORDER BY wp_seq, feature_seq) AS rn
      FROM (SELECT w.route_id, w.variant, w.seq AS wp_seq, s.feature_seq, s.name, s.place AS type, s.population,
                   round(s.lat, 5) AS lat, round(s.lon, 5) AS lon,
                   {planar('w.lat', 'w.lon', 's.lat', 's.lon')} * 111 AS exact, round(exact, 2) AS km
            FROM wp w, settlement s) WHERE exact <= 10) WHERE rn = 1""")

cte("near_tourism", "wp tourism", f"""
SELECT route_id, variant, name, score, lat, lon, km AS distance_from_route_km, found.wp_seq AS wp_seq,
       found.feature_seq AS feature_seq
FROM (SELECT *, row_number() OVER (PARTITION BY route_id, variant, name ORDER BY km, wp_seq, feature_seq) AS rn,
             min({{'wp_seq': wp_seq, 'feature_seq': feature_seq}}) OVER (PARTITION BY route_id, variant, name) AS found
      FROM (SELECT w.route_id, w.variant, w.seq AS wp_seq, s.feature_seq, s.name, s.score, s.lat, s.lon,
                   {planar('w.lat', 'w.lon', 's.lat', 's.lon')} * 111 AS exact, round(exact, 2) AS km
            FROM wp w, tourism s) WHERE exact <= 10) WHERE rn = 1""")

cte("social", "wp near_settlement near_tourism", """
SELECT route_id, variant, least(20, coalesce(n, 0))::BIGINT AS settlements, coalesce(s, 0)::BIGINT AS tourism_score,
       (10 * least(20, coalesce(n, 0)) + coalesce(s, 0))::BIGINT AS social_impact_score
FROM (SELECT DISTINCT route_id, variant FROM wp)
LEFT JOIN (SELECT route_id, variant, count(*) AS n FROM near_settlement GROUP BY ALL) USING (route_id, variant)
LEFT JOIN (SELECT route_id, variant, sum(score) AS s FROM near_tourism GROUP BY ALL) USING (route_id, variant)""")

cte("utilization", "leg", f"""
SELECT route_id, variant, round(total, 2) AS total_distance_km, round(existing, 2) AS existing_road_km,
       round(total - existing, 2) AS new_construction_km, round(pct, 1) AS utilization_percent,
       round(pct * 0.8::DOUBLE, 1) AS cost_savings_percent
FROM (SELECT *, CASE WHEN total > 0 THEN existing / total * 100 ELSE 0 END AS pct
      FROM (SELECT route_id, variant, sum(km ORDER BY seg) AS total,
                   sum(CASE WHEN {near_corridor('lat1', 'lon1')} OR {near_corridor('lat2', 'lon2')} THEN km ELSE 0 END
                       ORDER BY seg) AS existing
            FROM leg GROUP BY route_id, variant))""")

cte("station", "leg", f"""
SELECT route_id, variant, idx, lat, lon, ground, design, prev, ground - design AS depth, start_level, end_level, last_idx
FROM (SELECT *, lag(trunc(design)) OVER w AS prev
      FROM (SELECT *, CASE WHEN idx = 0 THEN ground ELSE
                   start_level + (end_level - start_level) * ((idx * 50)::DOUBLE / (last_idx * 50)) END AS design
            FROM (SELECT *, first_value(ground) OVER w AS start_level, last_value(ground) OVER w AS end_level,
                         max(idx) OVER (PARTITION BY route_id, variant) AS last_idx
                  FROM (SELECT *, {elevation('lat', 'lon')} AS ground,
                               row_number() OVER (PARTITION BY route_id, variant ORDER BY seg, j) - 1 AS idx
                        FROM (SELECT route_id, variant, seg, j, lat1 + (j::DOUBLE / n) * (lat2 - lat1) AS lat,
                                     lon1 + (j::DOUBLE / n) * (lon2 - lon1) AS lon
                              FROM (SELECT *, unnest(range(0, n + 1)) AS j
                                    FROM (SELECT *, greatest(1, trunc(km * 1000 / 50))::INTEGER AS n FROM leg))))
                  WINDOW w AS (PARTITION BY route_id, variant ORDER BY idx
                               ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)))
      WINDOW w AS (PARTITION BY route_id, variant ORDER BY idx))""")

cte("survey", "station", """
SELECT route_id, variant, idx, idx * 50 AS chainage_m, lat, lon, ground, design, depth, start_level, end_level,
       CASE WHEN depth > 0 THEN (5.5::DOUBLE + 1.5::DOUBLE * depth) * depth
            WHEN depth < 0 THEN (5.5::DOUBLE + 2.0::DOUBLE * (-depth)) * (-depth) ELSE 0 END * 50 AS volume,
       CASE WHEN depth > 0 THEN 'cut' WHEN depth < 0 THEN 'fill' ELSE 'balanced' END AS kind,
       coalesce((design - prev) / 50 * 100, 0) AS gradient
FROM station""")

cte("earthwork", "survey", """
SELECT *, CASE WHEN abs(cut - fill) < 1000 THEN 'balanced' WHEN cut > fill THEN 'excess_cut' ELSE 'excess_fill' END
       AS balance_status,
       coalesce((end_level - start_level)::DOUBLE / nullif(total_length_m, 0) * 100, 0) AS slope_pct
FROM (SELECT route_id, variant, count(*) AS total_waypoints, max(chainage_m)::INTEGER AS total_length_m,
             max(abs(round(gradient, 2))) AS max_gradient_percent,
             round(avg(abs(round(gradient, 2))), 2) AS avg_gradient_percent,
             sum(CASE WHEN depth > 0 THEN volume ELSE 0 END ORDER BY idx) AS cut,
             sum(CASE WHEN depth < 0 THEN volume ELSE 0 END ORDER BY idx) AS fill,
             any_value(start_level) AS start_level, any_value(end_level) AS end_level
      FROM survey GROUP BY route_id, variant)""")

cte("plan", "request terrain site utilization bridge_count social earthwork", f"""
SELECT *, trunc((terrain_risk + flood_risk + seasonal) / 3)::INTEGER AS risk_score,
       trunc(seasonal)::INTEGER AS seasonal_risk
FROM (SELECT t.route_id, t.variant, t.elevation_gain_m, t.terrain_risk, u.* EXCLUDE (route_id, variant),
             b.bridges_required, s.settlements, s.social_impact_score, e.* EXCLUDE (route_id, variant),
             {planar('start_lat', 'start_lon', 'end_lat', 'end_lon')} * 111
               * CASE t.variant WHEN 'safest' THEN 1.25::DOUBLE ELSE 1 END AS km,
             CASE t.variant WHEN 'safest' THEN greatest(20, flood_base_risk - 15) ELSE flood_base_risk END AS flood_risk,
             rainfall_risk * CASE t.variant WHEN 'safest' THEN 0.8::DOUBLE ELSE 1::DOUBLE END AS seasonal,
             CASE t.variant WHEN 'safest' THEN 40 ELSE 50 END AS base,
             t.variant = 'shortest' AS recommended
      FROM terrain t JOIN request r USING (route_id) JOIN site USING (route_id)
      JOIN utilization u USING (route_id, variant) JOIN bridge_count b USING (route_id, variant)
      JOIN social s USING (route_id, variant) JOIN earthwork e USING (route_id, variant))""")

cte("way", "", """
SELECT o_orderkey AS way_id,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'primary' WHEN '2-HIGH' THEN 'secondary' WHEN '3-MEDIUM' THEN 'trunk'
            WHEN '4-NOT SPECIFIED' THEN 'tertiary' WHEN '5-LOW' THEN 'track' END AS highway_type,
       CASE o_orderstatus WHEN 'F' THEN 'asphalt' WHEN 'P' THEN 'gravel' END AS raw_surface,
       CASE WHEN o_orderkey % 5 <> 0 THEN 'Road ' || o_orderkey END AS raw_name,
       coalesce(raw_surface, 'unpaved') AS surface, coalesce(raw_name, 'Unnamed_Road_' || o_orderkey) AS name
FROM orders""")

cte("vertex", "node", """
SELECT way_id, pos, ref, lat, lon
FROM (SELECT l_orderkey AS way_id, l_partkey AS ref, row_number() OVER (PARTITION BY l_orderkey
             ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos FROM lineitem)
JOIN node ON node_id = ref""")

cte("major_way", "way vertex", f"""
SELECT * FROM way WHERE highway_type IN {MAJOR}
   AND (SELECT count(*) FROM vertex WHERE vertex.way_id = way.way_id) >= 2""")

cte("any_edge", "way vertex", f"""
SELECT a.way_id || '_' || a.pos AS edge_id, a.way_id, a.pos, a.ref AS source, b.ref AS target,
       a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2,
       {haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS distance_m, name, highway_type, surface
FROM vertex a JOIN vertex b ON a.way_id = b.way_id AND b.pos = a.pos + 1 JOIN way ON way.way_id = a.way_id""")

cte("edge", "any_edge major_way", "SELECT * FROM any_edge WHERE way_id IN (SELECT way_id FROM major_way)")

cte("network_node", "vertex major_way", """
SELECT ref AS node_id, arg_min(lat, {'w': way_id, 'p': pos}) AS lat, arg_min(lon, {'w': way_id, 'p': pos}) AS lon
FROM vertex WHERE way_id IN (SELECT way_id FROM major_way) GROUP BY ref""")

cte("classified", "any_edge", f"""
SELECT edge_id, way_id, distance_m,
       CASE WHEN way_id % 7 = 0 THEN 'new_construction' ELSE 'upgrade_existing' END AS construction_type,
       (CASE WHEN way_id % 7 = 0 THEN 1.0 WHEN highway_type IN {MAJOR} THEN 0.3
            WHEN highway_type IN ('tertiary', 'tertiary_link') THEN 0.5 WHEN surface IN {PAVED} THEN 0.4
            ELSE 0.7 END)::DOUBLE AS cost_factor
FROM any_edge""")


def snapped(points: str, key: str, nodes: str, radius_m: int) -> str:
    """Nearest node in reach per point, null beyond; ``points`` carries ``key``, lat and lon."""
    distance = planar("p.lat", "p.lon", "n.lat", "n.lon") + " * 111000"
    return f"""
SELECT {key}, p_lat AS lat, p_lon AS lon, CASE WHEN b.d <= {radius_m} THEN b.id END AS node_id,
       CASE WHEN b.d <= {radius_m} THEN b.d END AS snap_m, CASE WHEN b.d <= {radius_m} THEN b.lat END AS n_lat,
       CASE WHEN b.d <= {radius_m} THEN b.lon END AS n_lon
FROM (SELECT {key}, any_value(p.lat) AS p_lat, any_value(p.lon) AS p_lon,
             min({{'d': {distance}, 'id': n.node_id, 'lat': n.lat, 'lon': n.lon}}) AS b
      FROM {points} p, {nodes} n GROUP BY {key})"""


cte("request_end", "request", """
SELECT route_id, 'start' AS side, start_lat AS lat, start_lon AS lon FROM request
UNION ALL SELECT route_id, 'end', end_lat, end_lon FROM request""")
cte("end_all_nodes", "request_end node", snapped("request_end", "route_id, side", "node", 2000))
cte("end_network", "request_end network_node", snapped("request_end", "route_id, side", "network_node", 2000))

cte("ends", "end_network", """
SELECT route_id, max(CASE WHEN side = 'start' THEN node_id END) AS start_node,
       max(CASE WHEN side = 'end' THEN node_id END) AS end_node FROM end_network GROUP BY route_id""")

cte("sample", "request", """
SELECT route_id, i::INTEGER AS seq, start_lat + (i::DOUBLE / 10) * (end_lat - start_lat) AS lat,
       start_lon + (i::DOUBLE / 10) * (end_lon - start_lon) AS lon FROM request, unnest(range(0, 11)) r(i)""")
cte("sample_all_nodes", "sample node", snapped("sample", "route_id, seq", "node", 5000))
cte("sample_network", "sample network_node", snapped("sample", "route_id, seq", "network_node", 5000))

cte("criterion_cost", "edge", """
SELECT edge_id, source, target, c AS criterion, distance_m * CASE WHEN c = 'shortest' THEN 1
       WHEN highway_type IN ('primary', 'secondary') THEN 0.8 WHEN highway_type = 'track' THEN 1.5 ELSE 1 END::DOUBLE AS w
FROM edge, (VALUES ('shortest'), ('safest')) v(c)""")

cte("origin", "ends", """
SELECT DISTINCT c AS criterion, start_node AS origin FROM ends, (VALUES ('shortest'), ('safest')) v(c)
WHERE start_node IS NOT NULL AND end_node IS NOT NULL AND start_node <> end_node""")


cte("reach", "origin criterion_cost", """
  SELECT criterion, origin, origin AS node, 0::DOUBLE AS cost FROM origin
  UNION
  SELECT reach.criterion, reach.origin, e.target, min(reach.cost + e.w)
  FROM reach JOIN criterion_cost e ON e.source = reach.node AND e.criterion = reach.criterion
  LEFT JOIN recurring.reach k ON k.criterion = reach.criterion AND k.origin = reach.origin AND k.node = e.target
  WHERE k.cost IS NULL OR reach.cost + e.w < k.cost
  GROUP BY ALL""", "reach(criterion, origin, node, cost) USING KEY (criterion, origin, node)")

cte("tree", "reach criterion_cost", """
SELECT e.criterion, s.origin, e.target, min({'edge_id': e.edge_id, 'source': e.source}) AS came
FROM criterion_cost e JOIN reach s ON s.criterion = e.criterion AND s.node = e.source
JOIN reach t ON t.criterion = e.criterion AND t.origin = s.origin AND t.node = e.target
WHERE s.cost + e.w = t.cost AND e.source <> e.target GROUP BY e.criterion, s.origin, e.target""", "tree AS MATERIALIZED")

cte("back", "ends tree", """
  SELECT DISTINCT criterion, origin, target AS goal, came.source AS node, 0 AS hop, came.edge_id AS edge_id
  FROM ends JOIN tree ON origin = start_node AND target = end_node
  UNION ALL
  SELECT b.criterion, b.origin, b.goal, t.came.source, b.hop - 1, t.came.edge_id
  FROM back b JOIN tree t ON t.criterion = b.criterion AND t.origin = b.origin AND t.target = b.node
  WHERE b.node <> b.origin AND b.hop > -1000""", "back(criterion, origin, goal, node, hop, edge_id)")

cte("path", "ends back edge", """
SELECT route_id, criterion AS variant, hop, e.* FROM ends JOIN back ON origin = start_node AND goal = end_node
JOIN edge e USING (edge_id)""")

cte("path_stats", "path", """
SELECT route_id, variant, sum(distance_m ORDER BY hop) / 1000 AS total_distance_km,
       round(sum(distance_m / 1000 * 400000 ORDER BY hop), 2) AS estimated_cost
FROM path GROUP BY route_id, variant""")

# Waypoints of network routes, to stand in for those of the curves.
NETWORK_WP = (["path"], f"""
SELECT route_id, variant, (row_number() OVER (PARTITION BY route_id, variant ORDER BY nth) - 1)::INTEGER AS seq, lat, lon,
       {elevation('lat', 'lon')} AS elevation
FROM (SELECT *, row_number() OVER w - 1 AS nth, count(*) OVER (PARTITION BY route_id, variant) AS n
      FROM (SELECT *, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0
            FROM (SELECT route_id, variant, hop * 2 AS k, lat1 AS lat, lon1 AS lon FROM path
                  UNION ALL SELECT route_id, variant, hop * 2 + 1, lat2, lon2 FROM path)
            WINDOW w AS (PARTITION BY route_id, variant ORDER BY k))
      WHERE lat0 IS NULL OR lat0 <> lat OR lon0 <> lon
      WINDOW w AS (PARTITION BY route_id, variant ORDER BY k))
WHERE n <= 25 OR nth = 0 OR nth = n - 1 OR (nth % (n // 24) = 0 AND nth // (n // 24) BETWEEN 1 AND 23)""", "wp")

# The same before thinning.
WHOLE_WP = (["path"], f"""
SELECT route_id, variant, (row_number() OVER (PARTITION BY route_id, variant ORDER BY k) - 1)::INTEGER AS seq, lat, lon,
       {elevation('lat', 'lon')} AS elevation
FROM (SELECT *, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0
      FROM (SELECT route_id, variant, hop * 2 AS k, lat1 AS lat, lon1 AS lon FROM path
            UNION ALL SELECT route_id, variant, hop * 2 + 1, lat2, lon2 FROM path)
      WINDOW w AS (PARTITION BY route_id, variant ORDER BY k))
WHERE lat0 IS NULL OR lat0 <> lat OR lon0 <> lon""", "road_wp")

cte("export", "terrain request utilization", f"""
SELECT t.route_id, t.variant, t.elevation_gain_m, t.terrain_risk, context,
       CASE t.variant WHEN 'safest' THEN 'Safest Route' ELSE 'Shortest Route' END AS name,
       CASE t.variant WHEN 'safest' THEN 'Minimizes terrain and flood risks' ELSE 'Minimizes distance and travel time' END
       AS description,
       round({planar('start_lat', 'start_lon', 'end_lat', 'end_lon')} * 111
             * CASE t.variant WHEN 'safest' THEN 1.25::DOUBLE ELSE 1 END, 2) AS distance_km,
       round((new_construction_km * 35000 + existing_road_km * 5000) * (1 + terrain_risk / 100), 2) AS estimated_cost
FROM terrain t JOIN request USING (route_id) JOIN utilization USING (route_id, variant)""")

PLAIN = "regexp_replace({}::VARCHAR, '\\.0$', '')"


def plain(value: str) -> str:
    return PLAIN.format(value)


def kml(name: str, description: str, lines: str, style: str, extra: str) -> str:
    return f"""'<?xml version="1.0" encoding="UTF-8"?>
<kml xmlns="http://www.opengis.net/kml/2.2">
  <Document>
    <name>' || {name} || '</name>
    <description>' || {description} || '</description>
    <Style id="{style}">
      <LineStyle>
        <color>ff0000ff</color>
        <width>4</width>
      </LineStyle>
    </Style>
    <Placemark>
      <name>' || {name} || '</name>
' || {extra} || '      <styleUrl>#{style}</styleUrl>
      <LineString>
        <coordinates>
' || {lines} || '        </coordinates>
      </LineString>
    </Placemark>
  </Document>
</kml>'"""


def gpx(head: str, name: str, lines: str) -> str:
    return f"""{head} || '  <trk>
    <name>' || {name} || '</name>
    <trkseg>
' || {lines} || '    </trkseg>
  </trk>
</gpx>'"""


def kml_line(lon: str, lat: str, height: str) -> str:
    return f"'          ' || {lon} || ',' || {lat} || ',' || {height} || chr(10)"


def gpx_line(lon: str, lat: str, height: str) -> str:
    return (
        f"'      <trkpt lat=\"' || {lat} || '\" lon=\"' || {lon} || '\">' || chr(10) || '        <ele>' || {height} "
        f"|| '</ele>' || chr(10) || '      </trkpt>' || chr(10)"
    )


def joined(line: str, order: str, separator: str = "''") -> str:
    return f"string_agg({line}, {separator} ORDER BY {order})"


def fixed(value: str, places: int) -> str:
    return f"round({value}, {places})::DECIMAL(30,{places})::VARCHAR"


def volume(value: str) -> str:
    return (
        f"CASE WHEN {value} > 1000000 THEN {fixed(f'{value} / 1000000', 2)} || 'M m³' "
        f"WHEN {value} > 1000 THEN {fixed(f'{value} / 1000', 1)} || 'K m³' ELSE {value}::VARCHAR || ' m³' END"
    )
