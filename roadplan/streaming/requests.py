"""A stream of requests planned micro-batch by micro-batch."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from roadplan.plans.pipeline import judged_events


def request_stream(spark: SparkSession, path: str) -> DataFrame:
    """JSON request texts ``{"route_id": ..., "event": "..."}``, one per line, as files arrive."""
    return spark.readStream.schema("route_id bigint, event string").json(path)


def start_planning(
    stream: DataFrame, plan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Plan every micro-batch with the batch code.

    Each batch owns its folder and overwrites it, so a batch that is replayed after a failure leaves no
    duplicates. No state is kept between batches. A batch is parsed once; unusable requests and those outside the
    permitted area go to the rejects with a reason.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        judged = judged_events(batch).persist()
        usable = judged.where(F.col("reason").isNull()).drop("reason")
        plan(usable).write.mode("overwrite").parquet(f"{out}/plans/batch={batch_id}")
        judged.where(F.col("reason").isNotNull()).write.mode("overwrite").parquet(f"{out}/rejects/batch={batch_id}")
        judged.unpersist()

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
