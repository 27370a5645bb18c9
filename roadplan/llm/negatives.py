"""Hard-negative mining by slots.

An anchor's positives each ask for the best negatives up to a limit of their own. The limits, one under the other, cut the
scores into disjoint slots; the best ``k`` negatives of each slot are kept, first within a block of rows, then over all
blocks. A positive's negatives are the first ``k`` of the slots from its own downwards, so one sorted list per anchor,
of at most ``k`` times the slots, answers all its positives however their windows overlap.

Anchors are compared with all rows in blocks of bounded size on both sides. Blocks are dealt by a hash, so a label that a third
of all rows have is spread like any other, and only the best few of a block leave it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadplan.operators.spatial import checkpointed

POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these percentages of the positive's.
LOWER, UPPER = 30, 90
SCALE = 256
BLOCK_ROWS, BLOCK_ANCHORS = 16_384, 2_048
#: Anchors whose scores are held at once.
SLICE = 128
KEY = ["anchor_id", "akey"]


def integer_rows(vectors: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """(vec_id, label, q): integer vectors of the commonest length (the shortest of equally common ones)."""
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"),
        F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where("vec_id is not null and label is not null").where(F.coalesce(finite, F.lit(False)))
    rows = checkpointed(rows.select(
        "vec_id", "label", F.transform("v", lambda c: F.floor(c * SCALE).cast("long")).alias("q")).distinct())
    lengths = rows.groupBy(F.size("q").alias("length")).count().orderBy(F.desc("count"), "length").collect()
    return rows if len(lengths) < 2 else rows.where(F.size("q") == lengths[0].length)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64) if len(column) else np.zeros((0, 0), np.int64)


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products, exact: in floating point where every sum fits its 53 bits."""
    most = anchors.shape[1] * int(np.abs(anchors).max(initial=0)) * int(np.abs(rows).max(initial=0))
    if most >= 1 << 63:
        raise OverflowError("inner products do not fit 64 bits")
    if most < 1 << 53:
        return (anchors.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    return anchors @ rows.T


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties by smaller id."""
    at = np.arange(len(scores))
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def slots(scores: np.ndarray, uppers: np.ndarray) -> np.ndarray:
    """The slot of each score: the number of the least upper limit (ascending) that it doesn't exceed."""
    return np.searchsorted(uppers, scores, "left")


def _compared(rows: DataFrame, anchors: DataFrame, pick: Callable, extra: str, size: tuple[int, int]) -> DataFrame:
    """What ``pick`` takes from each block of rows for each anchor: the anchor's key, (vec_id, score) and ``extra``."""
    blocks = max(1, -(-rows.count() // size[0]))
    lots = max(1, -(-anchors.count() // size[1]))
    deal = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n, *key: F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")
    left = rows.select("*", own(blocks, "vec_id", "label", "q").alias("block"), deal(lots).alias("lot"))
    right = anchors.select("*", own(lots, *KEY).alias("lot"), deal(blocks).alias("block"))

    def compare(block: pd.DataFrame, lot: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(block) and len(lot):
            vectors, ids, labels = _matrix(block["q"]), block["vec_id"].to_numpy(), block["label"].to_numpy()
            for start in range(0, len(lot), SLICE):
                part = lot.iloc[start: start + SLICE]
                table = _scores(_matrix(part["q"]), vectors)
                for (_, anchor), scores in zip(part.iterrows(), table, strict=True):
                    found += [(anchor["anchor_id"], anchor["akey"], *row) for row in pick(anchor, ids, labels, scores)]
        return pd.DataFrame(found, columns=[*KEY, "vec_id", "score", *([extra.split()[0]] if extra else [])])

    schema = "anchor_id long, akey long, vec_id long, score long" + (f", {extra}" if extra else "")
    return left.groupBy("block", "lot").cogroup(right.groupBy("block", "lot")).applyInPandas(compare, schema)


def _first(rows: DataFrame, k: int, *key: str) -> DataFrame:
    order = Window.partitionBy(*key).orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, anchor: str = "vec_id % 100 = 0", label: Column | None = None, positives: int = POSITIVES,
    negatives: int = NEGATIVES, limits: tuple[int, int] = (LOWER, UPPER), id_col: str = "vec_id",
    vector_col: str = "embedding", block: tuple[int, int] = (BLOCK_ROWS, BLOCK_ANCHORS),
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Vectors are scaled and floored to integers, scores are inner products. ``anchor`` says which rows (column ``vec_id``)
    are anchors; their positives are the first ``positives`` other ids of the same label, the negatives of a positive the first
    ``negatives`` rows of other labels whose score is within ``limits`` percent of the positive's. Higher scores come
    first, ties go to the smaller id. A positive of negative score has no window, as its lower limit lies above its upper one.

    Rows with a null id, label or vector, a null or non-finite component, or a vector of another length than the commonest
    take no part. Rows that repeat id, label and vector count once; an id with several vectors or labels is several rows,
    each an anchor of its own. Other columns aren't read. An empty table, or one without anchors, gives an empty table.
    Inner products that don't fit 64 bits are an error.
    """
    rows = integer_rows(vectors, id_col, vector_col, F.col("label") if label is None else label)
    anchors = checkpointed(rows.where(anchor).select(
        F.col("vec_id").alias("anchor_id"), F.xxhash64("vec_id", "label", "q").alias("akey"), "label", "q"))
    lower, upper = limits

    def friends(own, ids, labels, scores) -> Iterator[tuple]:
        at = np.flatnonzero((labels == own["label"]) & (ids != own["anchor_id"]))
        return [(int(ids[i]), int(scores[i])) for i in at[best(scores[at], ids[at], positives)]]

    near = checkpointed(_first(_compared(rows, anchors, friends, "", block), positives, *KEY))
    windows = near.where("score >= 0").select(
        *KEY, F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"),
        F.expr(f"score * {upper} div 100").alias("highest"), F.expr(f"(score * {lower} + 99) div 100").alias("lowest"))
    asked = windows.groupBy(*KEY).agg(
        F.sort_array(F.collect_set("highest")).alias("uppers"), F.min("lowest").alias("floor"))
    asked = checkpointed(anchors.join(asked, KEY))

    def rivals(own, ids, labels, scores) -> Iterator[tuple]:
        uppers = np.asarray(own["uppers"], np.int64)
        at = np.flatnonzero((labels != own["label"]) & (scores >= own["floor"]) & (scores <= uppers[-1]))
        slot = slots(scores[at], uppers)
        found = []
        for s in range(len(uppers)):
            inside = at[slot == s]
            found += [(int(ids[i]), int(scores[i]), s) for i in inside[best(scores[inside], ids[inside], negatives)]]
        return found

    kept = _first(_compared(rows, asked, rivals, "slot int", block), negatives, *KEY, "slot")
    lists = kept.groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id"))).alias("list"))
    inside = F.filter("list", lambda x: (-x["less"] <= F.col("highest")) & (-x["less"] >= F.col("lowest")))
    chosen = windows.join(lists, KEY).select(
        "anchor_id", "positive_id", "positive_score", F.posexplode(F.slice(inside, 1, negatives)).alias("at", "negative"))
    return chosen.select(
        "anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"),
        F.col("negative.vec_id").alias("negative_id"), "positive_score", (-F.col("negative.less")).alias("negative_score"))


def mining_report(vectors: DataFrame) -> DataFrame:
    """Labels are moved on by one, modulo ten, where the id is divisible by seven."""
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return mine(vectors, label=moved)
