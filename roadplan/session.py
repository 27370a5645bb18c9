"""Session settings."""

import tempfile

from pyspark.sql import SparkSession


def local_session(app: str = "roadplan", cores: str = "8") -> SparkSession:
    """Session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(4 * int(cores)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    set_checkpoint_dir(spark)
    return spark


def set_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; only a local master may fall back to a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        shared = tempfile.mkdtemp(prefix="roadplan-checkpoint-")
    sc.setCheckpointDir(shared)
