"""Readers for rainfall, GeoJSON features, OSM XML and network snapshots."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadplan.functions.risk import DEFAULT_RAINFALL_MM
from roadplan.operators.sequence import number_rows

# Fixed value: the district looked up when none is named.
DEFAULT_DISTRICT = "Uttarkashi"

FEATURES = (
    "type string, features array<struct<geometry: struct<type: string, coordinates: string>, "
    "properties: struct<name: string, waterway: string, place: string, population: string>>>"
)
FEATURE_LINE = (
    "geometry struct<type: string, coordinates: string>, "
    "properties struct<name: string, waterway: string, place: string, population: string>"
)
NODE = "struct<id: string, lat: double, lon: double, elevation: int>"
EDGE = (
    "struct<id: string, source_node_id: string, target_node_id: string, coordinates: array<array<double>>, "
    "distance_m: double, name: string, highway_type: string, surface: string, condition: string>"
)
SNAPSHOT = f"nodes map<string, {NODE}>, edges map<string, {EDGE}>, metadata map<string, string>"


def choose_source(read: Callable[[], DataFrame], default: DataFrame) -> tuple[DataFrame, bool]:
    """``read()`` and True, or ``default`` and False when the source is missing or any of it cannot be read.

    The whole source is read once before the choice, so that a row that is broken behind good ones counts as well.
    """
    try:
        loaded = read()
        loaded.write.format("noop").mode("overwrite").save()
        return loaded, True
    except (PySparkException, Py4JJavaError):
        return default, False


def load_or_default(read: Callable[[], DataFrame], default: DataFrame) -> DataFrame:
    """``read()``, or ``default`` when the source is missing or any of it cannot be read."""
    return choose_source(read, default)[0]


def place_in_source() -> Column:
    """Order of a row among all rows of its source: file, block within it, row within the block."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"))


def rainfall_lines(lines: DataFrame, districts: list[str]) -> DataFrame:
    """Annual rainfall per district from CSV lines ``value``.

    A line counts for a district whose name it contains, as given or in capitals, if its last field is
    a number; the first such line (by ``line_no``) wins. A header has no number and drops out.
    """
    named = F.filter(
        F.array(*[F.lit(d) for d in districts]),
        lambda d: F.contains(F.col("value"), d) | F.contains(F.col("value"), F.upper(d)),
    )
    last = F.trim(F.element_at(F.split("value", ","), -1))
    return (
        lines.select(F.explode(named).alias("district"), last.try_cast("double").alias("annual_mm"), "line_no")
        .where(F.col("annual_mm").isNotNull())
        .groupBy("district").agg(F.min_by("annual_mm", "line_no").alias("annual_mm"))
    )


def read_rainfall(spark: SparkSession, path: str, districts: list[str] | None = None) -> DataFrame:
    """One row per named district; districts without a usable line get the default."""
    names = districts or [DEFAULT_DISTRICT]
    lines = spark.read.text(path).select("value", place_in_source().alias("line_no"))
    wanted = spark.createDataFrame([(n,) for n in names], "district string")
    found = rainfall_lines(lines, names)
    return wanted.join(found, "district", "left").select(
        "district", F.coalesce("annual_mm", F.lit(DEFAULT_RAINFALL_MM)).alias("annual_mm")
    )


def read_features(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """GeoJSON features as ``feature_seq, geometry, properties``.

    A FeatureCollection document is one JSON value and so one task's work; large data should come with one
    feature per line. Features are numbered in the order of files and lines, however the files are split. A feature that
    cannot be read is an error when it is reached.
    """
    if one_per_line:
        rows = spark.read.schema(FEATURE_LINE).option("mode", "FAILFAST").json(path)
        placed = rows.select(F.lit(0).alias("source"), place_in_source().alias("at"), "geometry", "properties")
        return number_rows(placed, "source", ["at"], "feature_seq").select(
            F.col("feature_seq").cast("bigint").alias("feature_seq"), "geometry", "properties")
    documents = spark.read.schema(FEATURES).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return documents.select(F.posexplode("features").alias("feature_seq", "f")).select(
        F.col("feature_seq").cast("bigint").alias("feature_seq"), "f.geometry", "f.properties"
    )


def line_vertices(features: DataFrame) -> DataFrame:
    """Vertices of the LineStrings."""
    lines = features.where(F.col("geometry.type") == "LineString")
    points = F.from_json("geometry.coordinates", "array<array<double>>")
    return lines.select(
        F.col("feature_seq").alias("river_id"),
        F.coalesce("properties.name", F.lit("Unnamed River")).alias("name"),
        F.col("properties.waterway").alias("waterway"), F.posexplode(points).alias("seq", "p"),
    ).select("river_id", "name", "waterway", "seq", F.col("p")[1].alias("lat"), F.col("p")[0].alias("lon"))


def point_places(features: DataFrame) -> DataFrame:
    """Settlements from Points with at least two coordinates; a population that is no number is null."""
    points = features.where(F.col("geometry.type") == "Point")
    at = F.from_json("geometry.coordinates", "array<double>")
    return points.withColumn("at", at).where(F.size("at") >= 2).select(
        "feature_seq", F.coalesce("properties.name", F.lit("Unnamed Settlement")).alias("name"),
        F.coalesce("properties.place", F.lit("village")).alias("place"),
        F.col("at")[1].alias("lat"), F.col("at")[0].alias("lon"),
        F.col("properties.population").try_cast("int").alias("population"),
    )


def read_osm_ways(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ways with tags, way membership and nodes from OSM XML."""
    ways = spark.read.format("xml").option("rowTag", "way").schema(
        "_id bigint, nd array<struct<_ref: bigint>>, tag array<struct<_k: string, _v: string>>"
    ).load(path)
    nodes = spark.read.format("xml").option("rowTag", "node").schema(
        "_id bigint, _lat double, _lon double"
    ).load(path)
    tags = F.map_from_entries(F.coalesce("tag", F.array().cast("array<struct<_k: string, _v: string>>")))
    return (
        ways.select(F.col("_id").alias("way_id"), tags.alias("tags")),
        ways.select(F.col("_id").alias("way_id"), F.posexplode("nd").alias("pos", "n"))
        .select("way_id", "pos", F.col("n._ref").alias("ref")),
        nodes.select(F.col("_id").alias("node_id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon")),
    )


def read_snapshot_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Nodes, edges and metadata of a (gzipped) JSON network document; None when there is none.

    The document is a single JSON value; ``sinks.snapshot`` writes the same network as Parquet.
    """
    missing = spark.createDataFrame([], SNAPSHOT)
    document = load_or_default(lambda: spark.read.schema(SNAPSHOT).option("multiLine", True).json(path), missing)
    if document is missing:
        return None
    nodes = document.select(F.explode("nodes").alias("key", "n")).select(
        F.coalesce("n.id", "key").alias("node_id"), "n.lat", "n.lon",
        F.coalesce("n.elevation", F.lit(0)).alias("elevation"),
    )
    edges = document.select(F.explode("edges").alias("key", "e")).select(
        F.coalesce("e.id", "key").alias("edge_id"), F.col("e.source_node_id").alias("source"),
        F.col("e.target_node_id").alias("target"),
        F.coalesce("e.coordinates", F.array().cast("array<array<double>>")).alias("coordinates"),
        F.coalesce("e.distance_m", F.lit(0.0)).alias("distance_m"), F.coalesce("e.name", F.lit("")).alias("name"),
        F.coalesce("e.highway_type", F.lit("unclassified")).alias("highway_type"),
        F.coalesce("e.surface", F.lit("unpaved")).alias("surface"), "e.condition",
    )
    metadata = document.select(F.explode_outer("metadata").alias("key", "value"))
    return nodes, edges, metadata


def file_hash(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 per file."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
