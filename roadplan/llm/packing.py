"""Best-fit packing with several permitted sequence lengths.

Pieces are taken from long to short. A piece goes to the open bin that it leaves least room in; if none has room, the
permitted length of least cost per token it can still get is opened; in the end each bin is cut down to the cheapest
permitted length that holds its contents. The cost of a length is ``FIXED + length + length**2 / QUADRATIC``: one part
per sequence, one per token, one for attention.

Shards of a bounded number of pieces, dealt by a hash of the id, are packed each by itself; so a hot source spreads out,
no task grows with the input, and each shard loses at most a few part-filled bins. Only ids and lengths move.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from roadplan.operators.spatial import checkpointed

LENGTHS = (512, 1024, 2048, 4096)
FIXED, QUADRATIC = 64.0, 8192.0
SHARD_PIECES = 50_000


def cost(length: int) -> float:
    return FIXED + length + length * length / QUADRATIC


def pack(pieces: list[int], lengths: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """(bin, offset, final bin length) per piece, for pieces sorted from long to short and none over the longest length."""
    left = sum(pieces)
    room: list[int] = []  # distinct free room, ascending
    open_bins: dict[int, list[int]] = {}  # free room -> bins, the latest last
    used: list[int] = []
    size: list[int] = []
    placed = []
    for piece in pieces:
        at = bisect_left(room, piece)
        if at < len(room):
            free = room[at]
            b = open_bins[free].pop()
            if not open_bins[free]:
                del open_bins[free]
                room.pop(at)
        else:
            b, free = len(used), min(
                (c for c in lengths if c >= piece), key=lambda c: (cost(c) / max(1, min(c, left)), c))
            used.append(0)
            size.append(free)
        placed.append((b, used[b]))
        used[b] += piece
        left -= piece
        free -= piece
        if free:
            if free not in open_bins:
                insort(room, free)
                open_bins[free] = []
            open_bins[free].append(b)
    final = [min((c for c in lengths if c >= u), key=cost) for u in used]
    return [(b, offset, final[b]) for b, offset in placed]


def packed_pieces(
    docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, length_col: str | None = None, id_col: str = "doc_id",
    text_col: str = "text", shard_pieces: int = SHARD_PIECES,
) -> DataFrame:
    """(id_col, piece, start, n_tokens, bin_id, bin_length, offset): where each piece of each document goes.

    The length of a document is ``length_col``, or else its number of words (parted by white space). A document longer
    than the longest permitted length is cut into pieces of that length and a rest; ``start`` is the piece's first token
    within the document, ``offset`` its place within the bin. Null, empty and wordless documents (or a length below
    one) are one piece of length 0 with null bin. Repeated rows are packed as often as they occur; other columns aren't read.
    Results depend on ids and lengths alone. An empty table gives an empty table.
    """
    lengths = tuple(sorted(set(lengths)))
    if length_col is None:
        words = F.split(F.btrim(F.coalesce(F.col(text_col), F.lit("")), F.lit(" \t\n\x0b\x0c\r")), "[ \\t\\n\\x0B\\f\\r]+")
        tokens = F.when(F.element_at(words, 1) == "", 0).otherwise(F.size(words))
    else:
        tokens = F.greatest(F.coalesce(F.col(length_col), F.lit(0)), F.lit(0))
    # words are counted once, and a null id is set apart: among others it would turn them to floating point in Python
    id_type = docs.schema[id_col].dataType
    known = F.coalesce(F.col(id_col), F.lit(0).cast(id_type)) if isinstance(id_type, IntegralType) else F.col(id_col)
    sized = checkpointed(docs.select(
        known.alias("id"), F.col(id_col).isNull().alias("none"), tokens.cast("long").alias("tokens")))
    longest = F.lit(lengths[-1])
    pieces = sized.select(
        "id", "none", "tokens", F.explode(F.sequence(F.lit(0), F.greatest(
            F.ceil(F.col("tokens") / longest) - 1, F.lit(0)).cast("int"))).alias("piece"),
    ).select("id", "none", "piece", (F.col("piece") * longest).cast("long").alias("start"),
             F.least(F.col("tokens") - F.col("piece") * longest, longest.cast("long")).cast("int").alias("n_tokens"))
    total = pieces.count()
    shards = max(1, -(-total // shard_pieces))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("id", "piece", F.lit(3)), F.lit(shards)).cast("int"))

    def pack_shard(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["n_tokens", "none", "id", "piece"], ascending=[False, True, True, True], kind="stable")
        filled = part["n_tokens"] > 0
        places = pack(part.loc[filled, "n_tokens"].tolist(), lengths)
        part["bin_no"] = pd.Series([p[0] for p in places], part.index[filled], dtype="Int64")
        part["offset"] = pd.Series([p[1] for p in places], part.index[filled], dtype="Int64")
        part["bin_length"] = pd.Series([p[2] for p in places], part.index[filled], dtype="Int64")
        return part

    out = pieces.groupBy("shard").applyInPandas(
        pack_shard, f"id {id_type.simpleString()}, none boolean, piece int, start long, n_tokens int, shard int, bin_no long, offset int, bin_length int")
    return out.select(
        F.when(~F.col("none"), F.col("id")).alias(id_col), "piece", "start", "n_tokens",
        F.concat_ws("-", "shard", F.when(F.col("bin_no").isNotNull(), F.col("bin_no"))).alias("_bin"), "bin_no", "shard",
        "bin_length", "offset",
    ).select(
        id_col, "piece", "start", "n_tokens", F.when(F.col("bin_no").isNotNull(), F.col("_bin")).alias("bin_id"),
        "bin_length", "offset")


def packed_sequences(docs: DataFrame, **options) -> DataFrame:
    """One row per bin: its length, fill and the documents' pieces in order; a bin holds at most its length in pieces."""
    pieces = packed_pieces(docs, **options).where("bin_id is not null")
    return pieces.groupBy("bin_id", "bin_length").agg(
        F.sum("n_tokens").alias("filled"),
        F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "start", "n_tokens"))).alias("pieces"),
    )
