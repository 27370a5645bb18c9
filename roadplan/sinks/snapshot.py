"""Network snapshots as Parquet, with the hash of the file they were made from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadplan.functions.cost import MAJOR_CLASSES
from roadplan.sources.files import file_hash, load_or_default

METADATA = (
    "source_file string, pbf_hash string, total_roads_parsed bigint, data_quality_issues bigint, "
    "total_nodes bigint, total_edges bigint, highway_types array<string>, bbox array<double>"
)


def write_snapshot(
    nodes: DataFrame, edges: DataFrame, stats: DataFrame, path: str, source_file: str,
    bbox: tuple[float, float, float, float] | None = None,
) -> None:
    """Edges are partitioned by road class, so that readers of some classes skip the rest."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("highway_type").parquet(f"{path}/edges")
    hashed = file_hash(nodes.sparkSession, source_file)
    described = stats.select(
        F.lit(source_file).alias("source_file"), F.col("total_roads").alias("total_roads_parsed"),
        "data_quality_issues", "total_nodes", "total_edges",
        F.array(*[F.lit(x) for x in MAJOR_CLASSES]).alias("highway_types"),
        (F.array(*[F.lit(x) for x in bbox]) if bbox else F.lit(None).cast("array<double>")).alias("bbox"),
    )
    one = hashed.agg(F.max("sha256").alias("pbf_hash")).withColumn("source_file", F.lit(source_file))
    described.join(one, "source_file").write.mode("overwrite").parquet(f"{path}/metadata")


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Nodes, edges and metadata, or None when the snapshot is missing."""
    missing = spark.createDataFrame([], METADATA)
    metadata = load_or_default(lambda: spark.read.parquet(f"{path}/metadata"), missing)
    if metadata is missing:
        return None
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"), metadata


def is_valid(metadata: DataFrame, source_file: str) -> bool:
    """Whether the snapshot was made from the file as it is now."""
    current = file_hash(metadata.sparkSession, source_file).select(F.col("sha256").alias("pbf_hash"))
    return not metadata.join(current, "pbf_hash", "left_semi").isEmpty()


def write_network_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as gzipped JSON lines."""
    nodes.write.mode("overwrite").option("compression", "gzip").json(f"{path}/nodes")
    edges.write.mode("overwrite").option("compression", "gzip").json(f"{path}/edges")
