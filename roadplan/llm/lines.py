"""Line dedup: drop every line that many documents hold.

Lines are exploded as hashes, distinct documents are counted per hash, and the lines over the threshold are left out when
a text is put together again in the order of its lines. A line that a third of all documents hold is a count that
map tasks add up first. The frequent hashes go to all tasks while they are few, and texts then never move; beyond that the
hashes of documents and the frequent ones meet in a shuffle join, and each document gets its own list. Looking a line up is a
search in a sorted array either way, so a text of many frequent lines costs no more than its length asks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadplan.operators.spatial import checkpointed

MIN_DOCUMENTS = 10
MIN_CHARS = 1
#: Up to so many frequent keys (16 bytes each) are sent to all tasks; beyond, keys are shuffled and joined.
BROADCAST_ROWS = 1_000_000
BLANKS = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    """The line without white space at both ends, ASCII letters lower-cased (only these are lower-cased in bytes)."""
    return line.strip(BLANKS).lower()


def _counts(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars)


def hashes(keys: list[bytes]) -> np.ndarray:
    """128 bits for each key, as two numbers."""
    digests = b"".join(hashlib.blake2b(key, digest_size=16).digest() for key in keys)
    return np.frombuffer(digests, np.int64).reshape(-1, 2)


def _held(rows: DataFrame, min_chars: int) -> DataFrame:
    """The columns of ``rows`` but the text, with ``a, b`` for every key in the text."""
    names = [c for c in rows.columns if c != "text"]

    def explode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found, counts = [], []
            for text in part.column("text").to_pylist():
                keys = {line_key(line) for line in (text or "").encode().split(b"\n")}
                keys = [key for key in keys if _counts(key, min_chars)]
                found += keys
                counts.append(len(keys))
            both = hashes(found)
            at = pa.array(np.repeat(np.arange(len(counts)), counts))
            columns = [part.column(c).take(at) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))],
                [*names, "a", "b"])

    types = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(explode, f"{types}, a long, b long")


def frequent_keys(docs: DataFrame, min_docs: int, min_chars: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b) of the keys that at least ``min_docs`` documents hold."""
    held = _held(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), min_chars)
    counted = held.distinct().groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    return checkpointed(counted.select("a", "b"))


def _among(both: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each pair of numbers is one of ``a, b`` (ascending by a, then b)."""
    at, last = np.searchsorted(a, both[:, 0], "left"), np.searchsorted(a, both[:, 0], "right")
    found = np.zeros(len(both), bool)
    while (open_ := at < last).any():
        found[open_] |= b[at[open_]] == both[open_, 1]
        at = at + 1
    return found


def _cleaned(texts: pd.Series, frequent, min_chars: int) -> pd.DataFrame:
    """(text, n_lines, n_dropped); ``frequent`` gives the sorted numbers a, b for the place of a text."""
    rows = []
    for i, text in enumerate(texts):
        lines = (text or "").encode().split(b"\n")
        keys = [line_key(line) for line in lines]
        gone = _among(hashes(keys), *frequent(i))
        kept = [
            line for line, key, drop in zip(lines, keys, gone.tolist(), strict=True)
            if not (drop and _counts(key, min_chars))
        ]
        rows.append((b"\n".join(kept).decode() if len(kept) < len(lines) else text or "", len(lines), len(lines) - len(kept)))
    return pd.DataFrame(rows, columns=["text", "n_lines", "n_dropped"])


def _sorted(a, b) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
    order = np.lexsort((b, a))
    return a[order], b[order]


def _with_lines(docs: DataFrame, min_docs: int, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with a column ``_lines`` of the text that stays and the two counts."""
    result = "text string, n_lines long, n_dropped long"
    frequent = frequent_keys(docs, min_docs, min_chars, id_col, text_col)
    if frequent.count() <= BROADCAST_ROWS:
        few = frequent.toPandas()
        shared = docs.sparkSession.sparkContext.broadcast(_sorted(few["a"], few["b"]))

        @F.pandas_udf(result)
        def clean(texts: pd.Series) -> pd.DataFrame:
            return _cleaned(texts, lambda i: shared.value, min_chars)

        return docs.withColumn("_lines", clean(F.col(text_col)))

    @F.pandas_udf(result)
    def clean_own(texts: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
        none = np.zeros(0, np.int64)
        return _cleaned(texts, lambda i: (none, none) if a[i] is None else _sorted(a[i], b[i]), min_chars)

    key: list[Column] = [F.col(id_col), F.xxhash64(F.col(text_col)), F.xxhash64(F.lit(1), F.col(text_col))]
    texts = docs.select(*[k.alias(f"_lines_{i}") for i, k in enumerate(key)], F.col(text_col).alias("text"))
    own = _held(texts, min_chars).distinct().join(frequent, ["a", "b"]).groupBy("_lines_0", "_lines_1", "_lines_2").agg(
        F.collect_list(F.struct("a", "b")).alias("_lines_k"))
    same = [k.eqNullSafe(F.col(f"_lines_{i}")) for i, k in enumerate(key)]
    rows = docs.join(own, same[0] & same[1] & same[2], "left")
    clean = clean_own(F.col(text_col), F.col("_lines_k.a"), F.col("_lines_k.b"))
    return rows.withColumn("_lines", clean).drop("_lines_0", "_lines_1", "_lines_2", "_lines_k")


def drop_frequent_lines(
    docs: DataFrame, min_docs: int = MIN_DOCUMENTS, min_chars: int = MIN_CHARS, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with the text that stays, ``n_lines`` (before) and ``n_dropped``.

    A null or empty text is one empty line and comes back as an empty text. Keys shorter than ``min_chars`` stay. Rows
    that share an id, a null id too, are one document when documents are counted; each row is returned. Columns named
    ``n_lines`` or ``n_dropped`` are replaced, all others are passed on. An empty table gives an empty table.
    """
    rows = _with_lines(docs.drop("n_lines", "n_dropped"), min_docs, min_chars, id_col, text_col)
    return rows.withColumns({
        "n_lines": F.col("_lines.n_lines"), "n_dropped": F.col("_lines.n_dropped"), text_col: F.col("_lines.text"),
    }).drop("_lines")


def without_frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCUMENTS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the text that stays; every other column, whatever its name, keeps its values."""
    whole = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))
    rows = _with_lines(whole, min_docs, min_chars, "doc_id", "text")
    return rows.select(*[
        F.col("_lines.text").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def line_report(docs: DataFrame) -> DataFrame:
    """Digest of the cleaned texts, one row per row of ``docs``."""
    rows = _with_lines(docs.select("doc_id", "text"), MIN_DOCUMENTS, MIN_CHARS, "doc_id", "text")
    return rows.select("doc_id", "_lines.n_lines", "_lines.n_dropped", F.sha2("_lines.text", 256).alias("kept_sha256"))
