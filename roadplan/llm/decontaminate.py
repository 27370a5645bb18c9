"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

A mask says which words of a window count; two texts that agree on them share a seed, whatever stands at the other
positions. Benchmark and training seeds are joined, and around each hit the two texts are laid side by side: an overlap is
a stretch of ``WINDOW`` words (or the whole item, if shorter) of which ``MATCH`` or more are equal in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadplan.operators.spatial import checkpointed

#: Three masks of six words, one of which hits every pattern of 3 unequal words in 15 (so also of 2 in 14) and of 2 in 12
#: (so also in 13): each overlap as defined has a seed.
LONG_MASKS = ("11101011", "1100100111", "110100000111")
#: The same for items of fewer than ``SHORT`` words: 2 unequal words in 10 or 11, 1 in 8 or 9.
SHORT_MASKS = ("110111", "11001011", "110100011")
MASKS = LONG_MASKS + SHORT_MASKS
SHORT, LEAST = 12, 8
WINDOW, MATCH = 15, 0.8
#: Up to so many benchmark seeds (about 24 bytes each) or hits are sent to all tasks; beyond, both sides are shuffled.
BROADCAST_ROWS = 1_000_000


def word_array(text: Column) -> Column:
    """Lower-case runs of letters and digits, as hashes."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def seeds(words: Column, mask: str) -> Column:
    """Hash of each window's counted words, by position; empty if the text is shorter than the mask."""
    counted = [i for i, m in enumerate(mask) if m == "1"]
    windows = F.sequence(F.lit(0), F.size(words) - len(mask))
    hashes = F.transform(windows, lambda i: F.xxhash64(F.lit(mask), *[F.get(words, i + k) for k in counted]))
    return F.when(F.size(words) >= len(mask), hashes)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def overlaps(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id_col, item_id, n_matched, window, doc_start, item_start), the best overlap of each document and item.

    Best: the most equal words within a window, then the least start in the document, then in the item. Items of
    fewer than ``LEAST`` words are held to the same share: one of five to seven words may be unequal, none of fewer. Items
    without words overlap nothing. Null, empty and shorter documents overlap nothing. Rows that share an id count as one document; a null id takes no part. Other columns aren't
    read. An empty table on either side gives an empty table.
    """
    every_item = benchmark.select("item_id", word_array(F.col("text")).alias("item_words")).where("item_id is not null")
    items = every_item.where(F.size("item_words") >= LEAST)
    sizes = {n for n, in every_item.select(F.least(F.size("item_words"), F.lit(SHORT))).distinct().collect()}
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")
    words = rows.select("id", word_array(F.col("text")).alias("words"))
    long, short = F.size("item_words") >= SHORT, F.size("item_words") < SHORT
    kinds = [(m, long) for m in LONG_MASKS]
    if any(LEAST <= n < SHORT for n in sizes):
        kinds += [(m, short) for m in SHORT_MASKS]

    item_seeds = [
        items.where(kind).select("item_id", F.posexplode(seeds(F.col("item_words"), m)).alias("item_at", "seed"))
        for m, kind in kinds]
    known = item_seeds[0]
    for more in item_seeds[1:]:
        known = known.unionByName(more)
    known_rows = known.count()
    every = [seeds(F.col("words"), m) for m, _ in kinds]
    aligned = F.array(*[F.coalesce(s, F.array().cast("array<bigint>")) for s in every])
    dealt = words.select("id", F.explode(aligned).alias("seeds")).select("id", F.posexplode("seeds").alias("at", "seed"))
    hits = dealt.join(_small(known, known_rows), "seed").select(
        "id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct()

    hits = checkpointed(hits)
    found = hits.join(_small(items, known_rows), "item_id")
    hit_rows = hits.count()
    side_by_side = words.join(_small(found, hit_rows * 40), "id")
    low = F.greatest(F.lit(0), -F.col("shift"))
    high = F.least(F.size("item_words"), F.size("words") - F.col("shift")) - 1
    equal = F.when(high >= low, F.transform(
        F.sequence(low, high),
        lambda i: (F.get(F.col("item_words"), i) == F.get(F.col("words"), i + F.col("shift"))).cast("int")))
    window = F.least(F.lit(WINDOW), F.size("item_words"))
    flags = side_by_side.select("id", "item_id", "shift", low.alias("low"), window.alias("window"), equal.alias("equal"))
    flags = flags.where(F.size("equal") >= F.col("window"))
    sums = F.transform(F.sequence(F.lit(0), F.size("equal") - F.col("window")), lambda s: F.struct(
        F.aggregate(F.slice(F.col("equal"), s + 1, F.col("window")), F.lit(0), lambda a, x: a + x).alias("n_matched"),
        (-(F.col("low") + s + F.col("shift"))).alias("doc_at"), (-(F.col("low") + s)).alias("item_at")))
    best = flags.select("id", "item_id", "window", F.array_max(sums).alias("b")).where(
        F.col("b.n_matched") >= F.ceil(F.col("window") * MATCH))
    found = best.groupBy("id", "item_id").agg(
        F.max("b").alias("b"), F.first("window").alias("window"),
    ).select(
        "id", "item_id", "b.n_matched", "window",
        (-F.col("b.doc_at")).alias("doc_start"), (-F.col("b.item_at")).alias("item_start"),
    )
    if any(0 < n < LEAST for n in sizes):
        found = found.unionByName(_brief_overlaps(words, every_item, sorted(n for n in sizes if 0 < n < LEAST)))
    return found.withColumnRenamed("id", id_col)


def brief_masks(n: int) -> list[str]:
    """Masks that hit every permitted pattern of unequal words in an item of ``n`` words, fewer than ``LEAST``."""
    if -(-n * 4 // 5) == n:
        return ["1" * n]
    return ["1" * k + "0" + "1" * (n - k - 1) for k in range(n)]


def _brief_overlaps(words: DataFrame, items: DataFrame, sizes: list[int]) -> DataFrame:
    """Best place of each document and item of one of ``sizes``; two masks that hit at one place have all words in common."""
    masks = [m for n in sizes for m in brief_masks(n)]

    def all_runs(of: str) -> Column:
        runs = [F.coalesce(F.transform(seeds(F.col(of), m), lambda seed, at: F.struct(
            seed.alias("seed"), at.alias("at"))), F.array().cast("array<struct<seed:bigint,at:int>>")) for m in masks]
        return F.explode(F.flatten(F.array(*runs))).alias("run")

    brief = items.where(F.size("item_words").between(1, LEAST - 1))
    known = [brief.where(F.size("item_words") == len(m)).select(
        "item_id", F.lit(len(m)).alias("n"), F.lit(m).alias("mask"), F.get(seeds(F.col("item_words"), m), 0).alias("seed"))
        for m in masks]
    whole = known[0]
    for more in known[1:]:
        whole = whole.unionByName(more)
    dealt = words.select("id", all_runs("words")).select("id", "run.seed", "run.at")
    hits = dealt.join(_small(whole, whole.count()), "seed").groupBy("id", "item_id", "n", "at").agg(
        F.count_distinct("mask").alias("masks"))
    allowed = F.ceil(F.col("n") * F.lit(MATCH)).cast("int")
    matched = F.when(F.col("masks") > 1, F.col("n")).otherwise(allowed)
    best = hits.groupBy("id", "item_id", "n").agg(F.max(F.struct(matched.alias("n_matched"), (-F.col("at")).alias("less"))).alias("b"))
    return best.select(
        "id", "item_id", "b.n_matched", F.col("n").alias("window"), (-F.col("b.less")).alias("doc_start"),
        F.lit(0).alias("item_start"))


def without_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that overlap a benchmark item."""
    gone = overlaps(docs, benchmark).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
