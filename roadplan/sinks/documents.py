"""KML, GPX, GeoJSON and response documents, one text per route or request."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadplan.functions import earthwork as E
from roadplan.functions import text as T
from roadplan.functions.digits import rows_of, texts
from roadplan.operators.places import head
from roadplan.operators.polyline import KEY, VARIANT_ORDER
from roadplan.operators import survey as S
from roadplan.operators.spatial import checkpointed
from roadplan.operators.survey import instruction_texts

# Line colour per criterion and the number of list entries a response keeps.
LAYER_COLORS = {"shortest": "#3b82f6", "safest": "#10b981", "budget": "#f97316", "social": "#a855f7"}
KEEP = {"survey_points": 10, "waypoints": 10, "river_crossings": 5, "nearby_settlements": 10, "tourism_spots": 3}
CREATOR = "roadplan"

# The kinds of data a route names, and the population text where none is known.
DATA_SOURCES = ["DEM", "Rainfall", "Rivers", "Settlements", "Tourism", "Roads"]
UNKNOWN = "Unknown"

# The texts around the coordinates in KML and GPX.
KML_HEAD = """<?xml version="1.0" encoding="UTF-8"?>
<kml xmlns="http://www.opengis.net/kml/2.2">
  <Document>
    <name>%s</name>
    <description>%s</description>
    <Style id="{style}">
      <LineStyle>
        <color>ff0000ff</color>
        <width>4</width>
      </LineStyle>
    </Style>
    <Placemark>
      <name>%s</name>
{extra}      <styleUrl>#{style}</styleUrl>
      <LineString>
        <coordinates>
"""
KML_TAIL = """        </coordinates>
      </LineString>
    </Placemark>
  </Document>
</kml>"""
GPX_TAIL = """    </trkseg>
  </trk>
</gpx>"""


def kml_text(name: Column, description: Column, lines: Column, style: str, note: Column | None = None) -> Column:
    """KML around the text of its coordinate lines; ``note`` is a second description on the placemark."""
    extra = "" if note is None else "      <description>%s</description>\n"
    head = KML_HEAD.format(style=style, extra=extra)
    values = [name, description, name] + ([] if note is None else [note])
    return F.concat(F.format_string(head, *values), lines, F.lit(KML_TAIL))


def gpx_text(name: Column, lines: Column, note: Column | None = None) -> Column:
    """GPX around the text of its track points; with ``note`` the namespace and a metadata block are added."""
    space = "" if note is None else ' xmlns="http://www.topografix.com/GPX/1/1"'
    meta = "" if note is None else "  <metadata>\n    <name>%s</name>\n    <desc>%s</desc>\n  </metadata>\n"
    head = (
        f'<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" creator="{CREATOR}"{space}>\n{meta}'
        "  <trk>\n    <name>%s</name>\n    <trkseg>\n"
    )
    values = ([] if note is None else [name, note]) + [name]
    return F.concat(F.format_string(head, *values), lines, F.lit(GPX_TAIL))


def geojson_text(coordinates: Column, properties: Column) -> Column:
    """FeatureCollection with one LineString; ``coordinates`` is their ready text, ``properties`` a JSON text."""
    return F.concat(
        F.lit('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":'
              '{"type":"LineString","coordinates":['),
        coordinates, F.lit("]},\"properties\":"), properties, F.lit("}]}"),
    )


# The texts between longitude, latitude and height, or latitude and longitude, of a point.
KML_POINT = "          ", ",", ",", "\n"
GPX_POINT = '      <trkpt lat="', '" lon="', '">\n        <ele>', "</ele>\n      </trkpt>\n"
COORDINATE = "[", ",", ",", "]"


def _between(texts: tuple[str, ...], *values: Column) -> Column:
    return F.concat(F.lit(texts[0]), *[x for v, t in zip(values, texts[1:], strict=True) for x in (v, F.lit(t))])


def kml_line(lon: Column, lat: Column, height: Column) -> Column:
    return _between(KML_POINT, lon, lat, height)


def gpx_line(lon: Column, lat: Column, height: Column) -> Column:
    return _between(GPX_POINT, lat, lon, height)


def coordinate(lon: Column, lat: Column, height: Column) -> Column:
    return _between(COORDINATE, lon, lat, height)


STATION = [
    "chainage_m", "lat", "lon", "ground_elevation_m", "design_elevation_m", "cut_fill_depth_m", "cut_fill_type",
    "cut_fill_volume_m3", "gradient_percent",
]
LINE_TEXTS = ["kml_lines", "gpx_lines", "coordinates", "waypoints"]
SURVEYED = ["legs", "start_level", "end_level"]
# Sizes of degrees that are printed without a power of ten, with room to spare.
LEAST_DEGREES, MOST_DEGREES = 0.01, 1000.0


def _plain_leg(g: Column) -> Column:
    """Whether the leg is known and all its stations have degrees of ordinary size."""
    ordinary = lambda x, dx: (
        F.greatest(F.abs(x), F.abs(x + dx)) <= MOST_DEGREES) & ((F.least(x, x + dx) >= LEAST_DEGREES) | (F.greatest(x, x + dx) <= -LEAST_DEGREES))
    return F.coalesce(g.n.isNotNull() & ordinary(g.lat1, g.dlat) & ordinary(g.lon1, g.dlon), F.lit(False))


def _route_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``LINE_TEXTS`` of routes of plain legs, a few routes at a time; other columns are passed on."""
    between = lambda texts, *values: [x for t, v in zip(texts, [*values, []], strict=True) for x in (t.encode(), *v)]
    for batch in batches:
        legs, (start, end) = batch["legs"], (batch[x].to_numpy(zero_copy_only=False).astype(np.int64) for x in SURVEYED[1:])
        sizes, flat = legs.value_lengths().to_numpy(), legs.flatten()
        leg = {x: flat.field(x).to_numpy(zero_copy_only=False) for x in ("n", "lat1", "lon1", "dlat", "dlon")}
        leg["n"] = leg["n"].astype(np.int64)
        first = np.concatenate(([0], np.cumsum(sizes)))
        names = [x for x in batch.schema.names if x not in SURVEYED]
        for i, j in S._lots(np.diff(np.concatenate(([0], np.cumsum(leg["n"] + 1)))[first])):
            part = slice(first[i], first[j])
            bounds, text = S.station_texts(sizes[i:j], {x: y[part] for x, y in leg.items()}, start[i:j], end[i:j])
            lat, lon, height = text["lat"], text["lon"], text["design_elevation_m"]
            quote = lambda x: b'"' if x == "cut_fill_type" else b""
            fields = [x for name in STATION for x in (b',"' + name.encode() + b'":' + quote(name), *text[name], quote(name)) if len(x)]
            fields[0] = b"{" + fields[0][1:]
            lines = [
                texts(rows_of(*between(KML_POINT, lon, lat, height)), bounds), texts(rows_of(*between(GPX_POINT, lat, lon, height)), bounds),
                [x[:-1] for x in texts(rows_of(*between(COORDINATE, lon, lat, height), b","), bounds)],
                [x[:-1] for x in texts(rows_of(*fields, b"},"), bounds)],
            ]
            yield pa.RecordBatch.from_arrays(
                [*[batch[x].slice(i, j - i) for x in names], *[pa.array(x, pa.binary()).view(pa.string()) for x in lines]],
                names=[*names, *LINE_TEXTS])


def survey_documents(routes: DataFrame, totals: DataFrame, names: Column) -> DataFrame:
    """KML, GPX and GeoJSON of the surveyed line, at formation level.

    ``totals`` is the earthwork per route. A route has one station per fifty metres; they end up in one text and are written in
    the route's own row (numpy, many routes at once). Of routes that have several rows, an
    unknown leg or degrees near zero the stations are listed, gathered in order and written by columns.
    """
    c = F.col
    gathered = S.surveyed_routes(routes).where(F.size("legs") > 0).groupBy(*KEY).agg(
        F.collect_list(F.struct(*SURVEYED)).alias("rows"))
    row = F.get("rows", F.lit(0))
    simple = (F.size("rows") == 1) & F.forall(row.legs, _plain_leg) & row.start_level.isNotNull() & row.end_level.isNotNull()
    stored = checkpointed(gathered.join(totals, KEY).withColumn("simple", simple))
    kept = [x for x in stored.columns if x not in ("rows", "simple")]
    parts = int(routes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a row is small, its texts are not
    spread = stored.where("simple").select(*kept, row.alias("r")).repartition(parts, *KEY).select(*kept, "r.*")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.select(*kept).schema)
    written = spread.mapInArrow(_route_texts, f"{fields}, " + ", ".join(f"{x} string" for x in LINE_TEXTS))
    others = stored.where("not simple")
    listed = _gathered_texts(S.station_table(S.leg_stations(others.select(*KEY, F.inline("rows")))))
    texts = written.unionByName(others.select(*kept).join(listed, KEY)).withColumn("name", names)
    summary = F.concat(
        F.lit("Road alignment for construction - Total Cut: "), c("total_cut_m3"), F.lit(" m³, Total Fill: "),
        c("total_fill_m3"), F.lit(" m³"),
    )
    figures = F.to_json(F.struct(
        "name", "total_length_m", c("total_cut_m3").alias("total_cut_volume_m3"),
        c("total_fill_m3").alias("total_fill_volume_m3"), F.lit(E.ROAD_WIDTH_M).alias("road_width_m"),
    ))
    properties = F.concat(
        F.substring(figures, F.lit(1), F.length(figures) - 1), F.lit(',"waypoints":['), c("waypoints"), F.lit("]}"))
    return texts.select(
        *KEY, "name", kml_text(c("name"), summary, c("kml_lines"), "routeLine").alias("kml"),
        gpx_text(c("name"), c("gpx_lines")).alias("gpx"), geojson_text(c("coordinates"), properties).alias("geojson"),
    )


def _gathered_texts(stations: DataFrame) -> DataFrame:
    """``LINE_TEXTS`` per route of the station table."""
    gathered = stations.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("idx", *STATION))).alias("s"))
    each = lambda f, separator: F.array_join(F.transform("s", lambda x: f(
        x.lon.cast("string"), x.lat.cast("string"), x.design_elevation_m.cast("string")
    )), separator)
    listed = F.to_json(F.transform("s", lambda x: x.dropFields("idx")))
    return gathered.select(
        *KEY, each(kml_line, "").alias("kml_lines"), each(gpx_line, "").alias("gpx_lines"),
        each(coordinate, ",").alias("coordinates"),
        F.substring(listed, F.lit(2), F.length(listed) - 2).alias("waypoints"),
    )


def waypoint_documents(routes: DataFrame) -> DataFrame:
    """KML, GPX and GeoJSON of the waypoints with file names.

    ``routes`` has ``waypoints, name, description, distance_km, elevation_gain_m, estimated_cost, risk_score``; numbers are printed
    without a trailing ``.0`` and a missing one as 0.
    """
    c = F.col
    number = lambda value: F.coalesce(T.plain_number(value), F.lit("0"))
    each = lambda f, separator: F.array_join(F.transform("waypoints", lambda x: f(
        T.plain_number(x.lon), T.plain_number(x.lat), F.coalesce(x.elevation, F.lit(0)).cast("string")
    )), separator)
    name = F.coalesce("name", F.lit("Route"))
    length = F.concat(F.lit("Distance: "), number(c("distance_km")), F.lit(" km"))
    quoted = lambda key, value: F.concat(F.lit(f'"{key}":'), value)
    listed = lambda value: F.to_json(F.array(value))
    text = lambda value: F.substring(listed(value), F.lit(2), F.length(listed(value)) - 2)
    properties = F.concat(F.lit("{"), F.concat_ws(
        ",", quoted("name", text(name)), quoted("description", text(F.coalesce("description", F.lit("")))),
        quoted("distance_km", number(c("distance_km"))), quoted("elevation_gain_m", number(c("elevation_gain_m"))),
        quoted("estimated_cost", number(c("estimated_cost"))), quoted("risk_score", number(c("risk_score"))),
    ), F.lit("}"))
    return routes.select(
        *KEY,
        kml_text(name, F.coalesce("description", F.lit("")), each(kml_line, ""), "routeStyle", length).alias("kml"),
        gpx_text(name, each(gpx_line, ""), length).alias("gpx"),
        geojson_text(each(coordinate, ","), properties).alias("geojson"),
        *[T.file_name(name, x).alias(f"{x}_file") for x in ("kml", "gpx", "geojson")],
    )


def road_features(edges: DataFrame, max_roads: int = 1000) -> DataFrame:
    """The first ``max_roads`` edges, by way and position, as GeoJSON features."""
    c = F.col
    first = edges.orderBy("way_id", "pos").limit(max_roads)
    pair = lambda lon, lat: F.array(c(lon), c(lat))
    return first.select("edge_id", F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(
            F.lit("LineString").alias("type"),
            F.array(pair("lon1", "lat1"), pair("lon2", "lat2")).alias("coordinates"),
        ).alias("geometry"),
        F.struct(
            c("edge_id").alias("id"), "name", "highway_type", "surface", "distance_m"
        ).alias("properties"),
    )).alias("feature"))


def road_collection(features: DataFrame) -> DataFrame:
    """One FeatureCollection from features already limited in number."""
    return features.agg(F.concat(
        F.lit('{"type":"FeatureCollection","features":['),
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("edge_id", "feature"))), lambda x: x.feature
        ), ","), F.lit("]}"),
    ).alias("document"))


def layer_config(routes: DataFrame) -> DataFrame:
    """Routes with their line colour."""
    colors = F.create_map(*[F.lit(x) for pair in LAYER_COLORS.items() for x in pair])
    return routes.withColumn("color", colors[F.col("variant")])


def trimmed(rows: DataFrame, name: str, order: list[str], keep: int, fields: list[str]) -> DataFrame:
    """The first ``keep`` rows per route gathered in an array called ``name``."""
    first = head(rows, keep, *[F.col(o) for o in order])
    item = F.struct(F.col("rank"), *fields)
    return first.groupBy(*KEY).agg(F.transform(
        F.array_sort(F.collect_list(item)), lambda x: x.dropFields("rank")
    ).alias(name))


def response_documents(
    plan: DataFrame, routes: DataFrame, crossings: DataFrame, settlements: DataFrame, tourism: DataFrame,
    stations: DataFrame, requests: DataFrame, method: str = "mathematical",
) -> DataFrame:
    """One JSON document per request with its routes, their trimmed lists and the recommended id.

    The lists are cut to their response length per route before they are gathered.
    """
    c = F.col
    parts = [
        routes.select(*KEY, F.slice("waypoints", 1, KEEP["waypoints"]).alias("waypoints")),
        trimmed(crossings, "river_crossings", ["seg", "river_id"], KEEP["river_crossings"],
                ["lat", "lon", "river_name", "bridge_required", "estimated_span_m"]),
        trimmed(settlements.withColumn("population", F.coalesce(c("population").cast("string"), F.lit(UNKNOWN))),
                "nearby_settlements", ["distance_from_route_km", "wp_seq", "feature_seq"],
                KEEP["nearby_settlements"], ["name", "type", "lat", "lon", "distance_from_route_km", "population"]),
        trimmed(tourism.withColumn("score_rank", -c("score")).withColumnRenamed("score", "tourism_score"), "tourism_spots",
                ["score_rank", "wp_seq", "feature_seq"], KEEP["tourism_spots"],
                ["name", *[x for x in ("type", "description") if x in tourism.columns], "tourism_score", "lat", "lon",
                 "distance_from_route_km"]),
        trimmed(stations.where(c("idx") < KEEP["survey_points"]), "detailed_waypoints", ["idx"],
                KEEP["survey_points"], [x for x in stations.columns if x not in (*KEY, "idx")]),
    ]
    joined = plan
    for part in parts:
        joined = joined.join(part, KEY, "left")
    empty = lambda name: F.coalesce(c(name), F.from_json(F.lit("[]"), joined.schema[name].dataType)).alias(name)
    route = F.struct(
        *[c(x) for x in ("id", "name", "description", "priority", "distance_km")],
        c("distance_km").alias("total_distance_km"), c("elevation_gain_m"), c("construction_difficulty"),
        c("estimated_cost"), c("estimated_cost").alias("estimated_cost_usd"), c("estimated_days"), c("risk_score"),
        F.struct(
            c("terrain_risk").alias("terrain"), c("seasonal_risk").alias("rainfall"), c("flood_risk").alias("flood"),
            c("risk_score").alias("overall"),
        ).alias("risk_scores"),
        F.struct("terrain_risk", "flood_risk", "seasonal_risk").alias("risk_factors"),
        "bridges_required", empty("waypoints"), empty("river_crossings"), empty("nearby_settlements"),
        empty("tourism_spots"),
        F.struct(
            c("total_distance_km"), c("existing_road_km"), c("new_construction_km"), c("utilization_percent"),
            c("cost_savings_percent"),
        ).alias("road_utilization"),
        "social_impact_score",
        F.struct(
            empty("detailed_waypoints"), c("total_waypoints"), c("total_length_m"), c("max_gradient_percent"),
            c("avg_gradient_percent"),
            F.struct("total_cut_m3", "total_fill_m3", "balance_m3", "balance_status",
                     F.lit(E.ROAD_WIDTH_M).alias("road_width_m")).alias("earthwork"),
            F.struct(*instruction_texts()).alias("field_instructions"),
        ).alias("construction_data"),
        F.array(*[F.lit(x) for x in DATA_SOURCES]).alias("data_sources_used"),
    )
    order = F.create_map(*[F.lit(x) for pair in VARIANT_ORDER.items() for x in pair])[c("variant")]
    per_request = joined.groupBy("route_id").agg(
        F.array_sort(F.collect_list(F.struct(order.alias("order"), route.alias("route")))).alias("r")
    )
    first = F.get("r", F.lit(0)).route
    document = F.to_json(F.struct(
        F.lit(True).alias("success"),
        F.struct(
            F.struct(c("start_lat").alias("lat"), c("start_lon").alias("lon")).alias("start"),
            F.struct(c("end_lat").alias("lat"), c("end_lon").alias("lon")).alias("end"),
        ).alias("request"),
        F.transform("r", lambda x: x.route).alias("routes"),
        first.id.alias("recommended_route_id"),
        F.struct(F.lit(method).alias("routing_method")).alias("metadata"),
        T.fallback_explanation(first["name"]).alias("ai_explanation"),
    ))
    return per_request.join(requests, "route_id").select("route_id", document.alias("document"))


def stamped(documents: DataFrame) -> DataFrame:
    """Documents with the time they were made, as text."""
    return documents.withColumn("timestamp", T.iso_timestamp(F.current_timestamp()))


def document_files(documents: DataFrame, column: str, suffix: str) -> DataFrame:
    """(file_name, text) per route; names hold the route's key, so no two routes share one."""
    name = F.concat_ws("_", *[F.col(x).cast("string") for x in KEY])
    return documents.select(F.concat(name, F.lit(f".{suffix}")).alias("file_name"), F.col(column).alias("text"))


def write_documents(documents: DataFrame, column: str, path: str) -> None:
    """All documents of a kind as Parquet rows of file name and text, in as many files as there are partitions."""
    document_files(documents, column, column).write.mode("overwrite").parquet(path)


def export_files(spark: SparkSession, path: str, out: str, file_names: list[str]) -> None:
    """One folder with one text for each of the routes asked for, read back from what ``write_documents`` wrote."""
    chosen = spark.read.parquet(path).where(F.col("file_name").isin(file_names))
    chosen.select("file_name", F.col("text").alias("value")).write.partitionBy("file_name").mode("overwrite").option(
        "lineSep", "\n").text(out)
