"""Geography derived from the test tables, which carry no coordinates of their own."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadplan.operators.sequence import number_rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(key, factor: int, modulus: int, origin: float):
    """Deterministic coordinate for an integer key."""
    return F.lit(origin) + (key * factor % modulus) / 1000


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per customer; its rainfall district is the customer's region."""
    key = F.col("c_custkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("district"))
    homes = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "district")
    return (
        table(spark, sf_dir, "customer")
        .select("c_custkey", "c_nationkey", "c_mktsegment")
        .join(homes, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            key.alias("route_id"),
            spread(key, 7919, 2900, 28.6).alias("start_lat"),
            spread(key, 104729, 3500, 77.5).alias("start_lon"),
            spread(key, 6101, 2900, 28.6).alias("end_lat"),
            spread(key, 50021, 3500, 77.5).alias("end_lon"),
            "district",
            F.col("c_mktsegment").alias("context"),
        )
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("node_id"),
        spread(key, 6151, 2900, 28.6).alias("lat"),
        spread(key, 15485863, 3500, 77.5).alias("lon"),
    )


def way_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Way membership rows ``(way_id, pos, ref)``; the lines of an order are its vertices."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *order)
    return number_rows(lines, "l_orderkey", order, "pos").select(
        F.col("l_orderkey").alias("way_id"), "pos", F.col("l_partkey").alias("ref")
    )


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways with an OSM-like tag map; absent tags are absent keys."""
    highway = F.element_at(
        F.create_map(*[F.lit(x) for x in (
            "1-URGENT", "primary", "2-HIGH", "secondary", "3-MEDIUM", "trunk",
            "4-NOT SPECIFIED", "tertiary", "5-LOW", "track",
        )]),
        F.col("o_orderpriority"),
    )
    surface = F.when(F.col("o_orderstatus") == "F", "asphalt").when(F.col("o_orderstatus") == "P", "gravel")
    name = F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("Road "), F.col("o_orderkey")))
    tags = F.map_filter(
        F.create_map(F.lit("highway"), highway, F.lit("surface"), surface, F.lit("name"), name),
        lambda _, v: v.isNotNull(),
    )
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("way_id"), tags.alias("tags"))


def settlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        key.alias("feature_seq"),
        F.col("s_name").alias("name"),
        F.when(key % 5 == 0, "town").otherwise("village").alias("place"),
        spread(key, 4091, 2900, 28.6).alias("lat"),
        spread(key, 7013, 3500, 77.5).alias("lon"),
        F.when(F.col("s_acctbal") >= 0, F.floor("s_acctbal").cast("int")).alias("population"),
    )


def tourism(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        key.alias("feature_seq"),
        F.col("n_name").alias("name"),
        spread(key, 1301, 2900, 28.6).alias("lat"),
        spread(key, 1709, 3500, 77.5).alias("lon"),
        (5 + key % 16).alias("score"),
    )


def river_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty rivers; ``seq`` counts up without gaps inside each."""
    river = F.col("p_partkey") % 50
    seq = F.floor(F.col("p_partkey") / 50)
    return table(spark, sf_dir, "part").select(
        river.alias("river_id"),
        F.concat(F.lit("River "), river).alias("name"),
        seq.alias("seq"),
        (F.lit(28.6) + ((river * 577) % 2600 + F.abs((seq * 37) % 600 - 300)) / 1000).alias("lat"),
        (F.lit(77.5) + ((river * 911) % 3200 + F.abs((seq * 53) % 600 - 300)) / 1000).alias("lon"),
    )


def rainfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(
        F.col("r_name").alias("district"), (900 + 300 * F.col("r_regionkey")).cast("double").alias("annual_mm")
    )
