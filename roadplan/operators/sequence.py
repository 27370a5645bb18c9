"""Numbering rows inside keys of any size, and finding each row's successor."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadplan.operators.spatial import HOT_ROWS, checkpointed


def number_rows(df: DataFrame, key: str, order: list[str], name: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``df`` with ``name``: the row's position in its key, from 0, in the given (unique) order.

    Keys of ordinary size use a window. The rows of larger keys are sorted into ranges across the cluster,
    numbered inside each range and shifted by the sizes of the ranges before, so that no task holds a
    whole key. There are at most ``rows / hot_rows`` larger keys, which bounds the broadcasts.
    """
    window = W.partitionBy(key).orderBy(*order)
    hot = df.groupBy(key).count().where(F.col("count") > hot_rows).select(key)
    if hot.isEmpty():
        return df.withColumn(name, F.row_number().over(window) - 1)
    hot = F.broadcast(checkpointed(hot))
    usual = df.join(hot, key, "left_anti").withColumn(name, F.row_number().over(window) - 1)
    ranges = checkpointed(
        df.join(hot, key, "left_semi").repartitionByRange(key, *order).withColumn("range_no", F.spark_partition_id())
    )
    inside = F.row_number().over(W.partitionBy(key, "range_no").orderBy(*order)) - 1
    before = F.sum("count").over(
        W.partitionBy(key).orderBy("range_no").rowsBetween(W.unboundedPreceding, -1)
    )
    shifts = ranges.groupBy(key, "range_no").count().select(
        key, "range_no", F.coalesce(before, F.lit(0)).alias("shift")
    )
    numbered = ranges.withColumn("inside", inside).join(F.broadcast(shifts), [key, "range_no"]).select(
        *df.columns, (F.col("inside") + F.col("shift")).cast("int").alias(name)
    )
    return usual.unionByName(numbered)


def with_next(df: DataFrame, key: str, order: str, columns: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """``df`` with ``next_<column>`` of the row that follows in its key, null at the key's end.

    ``order`` may have gaps. Keys of ordinary size use a window; the rows of larger keys are numbered across the cluster
    and joined with their successors by number, so that no task holds a whole key.
    """
    window = W.partitionBy(key).orderBy(order)
    following = lambda rows: rows.select("*", *[F.lead(c).over(window).alias(f"next_{c}") for c in columns])
    hot = df.groupBy(key).count().where(F.col("count") > hot_rows).select(key)
    if hot.isEmpty():
        return following(df)
    hot = F.broadcast(checkpointed(hot))
    numbered = checkpointed(number_rows(df.join(hot, key, "left_semi"), key, [order], "_number", hot_rows))
    after = numbered.select(
        key, (F.col("_number") - 1).alias("_number"), *[F.col(c).alias(f"next_{c}") for c in columns])
    joined = numbered.join(after, [key, "_number"], "left").drop("_number")
    return following(df.join(hot, key, "left_anti")).unionByName(joined)
