"""Quality classifier by positive-unlabelled learning.

A linear model over text features is fitted by minimising the non-negative unbiased risk
``prior * risk(positives as 1) + max(0, risk(unlabelled as 0) - prior * risk(positives as 0))`` with the logistic loss;
where the bracket falls below zero its gradient is turned round, so the model can't push unlabelled text below what the
positives explain. Trusted positives are labelled rows, unlabelled text is a sample of all documents, and the class prior
is the share of positives among all rows that may be learned from. A two-parameter logistic fit on the same labelled rows
turns the margin into a probability.

The fit uses samples of at most about ``SAMPLE_ROWS`` labelled and as many unlabelled rows (and ``SAMPLE_CHARS`` characters each),
chosen by a hash of the id; the prior is counted over all rows, and every whole text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadplan.llm.words import batches, mix, word_hashes

SAMPLE_ROWS, SAMPLE_CHARS = 6_000, 30_000_000
ACCEPT = 0.7

#: Byte classes: letters, digits, white space and bytes above 127 by kind, each punctuation mark by itself.
_CLASS = np.zeros(256, np.int64)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = (
        0 if "a" <= _c <= "z" else 1 if "A" <= _c <= "Z" else 2 if _b == 195 or _b == 196 else 3 if _b >= 128
        else 4 if _c.isdigit() else 5 if _b == 10 else 6 if _c.isspace() or _b < 32 or _b == 127
        else 7 + "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~".index(_c))
KINDS = 40
WORD_BUCKETS = 1 << 13
SHAPES = ["log_bytes", "log_words", "repeats", "distinct", "log_word_length", "bias"]
FEATURES = KINDS + KINDS * KINDS + len(SHAPES) + WORD_BUCKETS


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of all texts: shares of byte kinds and of pairs of them, shapes, shares of hashed words."""
    n = len(texts)
    parts = [t.encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(p) + 1 for p in parts])
    kinds = _CLASS[np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)]
    row = np.repeat(np.arange(n), sizes)
    single = np.bincount(row * KINDS + kinds, minlength=n * KINDS).reshape(n, KINDS)
    code = row[:-1] * (KINDS * KINDS) + kinds[:-1] * KINDS + kinds[1:]
    pairs = np.bincount(code, minlength=n * KINDS * KINDS).reshape(n, -1)
    hashes, first = word_hashes(texts)
    words = np.diff(first)
    word_row = np.repeat(np.arange(n), words)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (word_row[1:] == word_row[:-1])
    bucket = (mix(hashes + np.uint64(7)) % np.uint64(WORD_BUCKETS)).astype(np.int64)
    cells, held = np.unique(word_row * WORD_BUCKETS + bucket, return_counts=True)
    some = np.maximum(words, 1)
    shapes = np.column_stack([
        np.log1p(sizes - 1) / 10, np.log1p(words) / 10, np.bincount(word_row, again, n) / some,
        np.bincount(cells // WORD_BUCKETS, minlength=n) / np.sqrt(some) / 10, np.log1p((sizes - 1) / some) / 3, np.ones(n),
    ])
    r2, f2 = np.nonzero(single)
    r3, f3 = np.nonzero(pairs)
    rows = [r2, r3, np.repeat(np.arange(n), len(SHAPES)), cells // WORD_BUCKETS]
    columns = [f2, KINDS + f3, np.tile(np.arange(len(SHAPES)), n) + KINDS + KINDS * KINDS,
               cells % WORD_BUCKETS + (FEATURES - WORD_BUCKETS)]
    values = [np.sqrt(single[r2, f2] / sizes[r2]), np.sqrt(pairs[r3, f3] / sizes[r3]), shapes.ravel(),
              np.sqrt(held / some[cells // WORD_BUCKETS]) / 20]
    return np.concatenate(rows), np.concatenate(columns), np.concatenate(values)


def margins(texts: list[str], weights: np.ndarray) -> np.ndarray:
    out = np.zeros(len(texts))
    for i, j in batches(texts, 1 << 19):
        rows, columns, values = features(texts[i:j])
        out[i:j] = np.bincount(rows, values * weights[columns], j - i)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


class Rows:
    """Sparse rows of a sample."""

    def __init__(self, texts: list[str]):
        found = []
        for i, j in batches(texts, 1 << 19):
            r, c, v = features(texts[i:j])
            found.append(((r + i).astype(np.int32), c.astype(np.int32), v.astype(np.float32)))
        self.n = len(texts)
        self.row, self.column, self.value = (np.concatenate(x) for x in zip(*found, strict=True))

    def margin(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.n)

    def gradient(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * g[self.row], FEATURES)


def fit_nnpu(
    positive: Rows, unlabelled: Rows, prior: float, rounds: int = 250, rate: float = 0.05, ridge: float = 1e-4,
) -> np.ndarray:
    """Weights that minimise the non-negative risk, by Adam over the whole sample."""
    w, m, v = np.zeros(FEATURES), np.zeros(FEATURES), np.zeros(FEATURES)
    for step in range(1, rounds + 1):
        zp, zu = positive.margin(w), unlabelled.margin(w)
        as_one = positive.gradient(prior * (_sigmoid(zp) - 1) / positive.n)
        rest = unlabelled.gradient(_sigmoid(zu) / unlabelled.n) - positive.gradient(prior * _sigmoid(zp) / positive.n)
        bracket = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g = (as_one + rest if bracket >= 0 else -rest) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def calibrate(z: np.ndarray, label: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of the logistic fit of labels on margins, by Newton steps on a lightly smoothed likelihood."""
    scale = z.std() or 1.0
    x = np.column_stack([z / scale, np.ones(len(z))])
    target = (label * len(z) + 0.5) / (len(z) + 1)
    ab = np.zeros(2)
    for _ in range(rounds):
        p = _sigmoid(x @ ab)
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2)
        ab -= np.clip(np.linalg.solve(hessian, x.T @ (p - target) + 1e-2 * ab), -2, 2)
    return max(ab[0], 0.0) / scale, ab[1]


def remainder(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 4


def share_within(sized: DataFrame, bound_rows: int, bound_chars: int) -> float:
    """The share of rows (of a table with a column ``chars``) that keeps to both bounds, about."""
    n, chars = sized.agg(F.count("*"), F.coalesce(F.sum("chars"), F.lit(0))).first()
    return min(1.0, bound_rows / max(1, n), bound_chars / max(1, chars))


def in_share(share: float, salt: int) -> Column:
    """Whether a hash of ``doc_id`` falls into the share."""
    return F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1_000_000)) < int(share * 1_000_000) + (share == 1)


def sampled(rows: DataFrame, bound_rows: int, bound_chars: int, salt: int) -> DataFrame:
    """About ``bound_rows`` rows and ``bound_chars`` characters of (doc_id, text, ...), chosen by a hash of the id."""
    return rows.where(in_share(share_within(rows.select(F.length("text").alias("chars")), bound_rows, bound_chars), salt))


def sampled_with(rows: DataFrame, known: DataFrame, bound_rows: int, bound_chars: int, salt: int) -> DataFrame:
    """The same of ``rows`` joined with ``known``, which has one row per ``doc_id``.

    Only ids and lengths are shuffled to find the share; the rows of ``known`` that are then chosen are about
    ``bound_rows`` at most, so they are broadcast and no text moves before it is chosen.
    """
    sized = rows.select("doc_id", F.length("text").alias("chars")).join(known, "doc_id")
    share = min(share_within(sized, bound_rows, bound_chars), bound_rows / max(1, known.count()))
    return rows.where(in_share(share, salt)).join(F.broadcast(known.where(in_share(share, salt))), "doc_id")


class QualityModel:
    def __init__(self, weights: np.ndarray, slope: float, shift: float):
        self.weights, self.slope, self.shift = weights, slope, shift

    def scores(self, texts: list[str]) -> np.ndarray:
        return _sigmoid(self.slope * margins(texts, self.weights) + self.shift)


def fit_quality(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """Fit on labelled rows of ``docs`` (doc_id, text) whose crc32 remainder isn't 2.

    Ids with null or contradicting labels aren't learned from, null ids neither. Without positives, unlabelled rows or
    both classes among the labels there is nothing to fit: every score is then the prior (one half without labels).
    """
    rows = docs.select("doc_id", "text").where(remainder("doc_id") != 2)
    known = labels.where("quality in (0, 1)").groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").select("doc_id", "quality")
    known = known.where(remainder("doc_id") != 2)
    counts = dict(known.groupBy("quality").count().collect())
    ones, zeros = counts.get(1, 0), counts.get(0, 0)
    prior = (ones + 1) / (ones + zeros + 2)
    labelled = [(r.text or "", r.quality) for r in sampled_with(
        rows, known, SAMPLE_ROWS, SAMPLE_CHARS, 1).select("text", "quality").collect()]
    free = [r.text or "" for r in sampled(rows, SAMPLE_ROWS, SAMPLE_CHARS, 2).select("text").collect()]
    target = np.array([q for _, q in labelled])
    if not free or len(set(target)) < 2:
        return QualityModel(np.zeros(FEATURES), 0.0, float(np.log(prior / (1 - prior))))
    positive = Rows([t for t, q in labelled if q == 1])
    weights = fit_nnpu(positive, Rows(free), prior)
    slope, shift = calibrate(margins([t for t, _ in labelled], weights), target)
    return QualityModel(weights, slope, shift)


def with_quality(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted``; a null text is an empty text. Columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(shared.value.scores([t or "" for t in texts]))

    return docs.withColumn("score", scored(text_col)).withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", "text")
    held_out = F.coalesce(remainder("doc_id") == 2, F.lit(False)).alias("held_out")
    return with_quality(rows, fit_quality(rows, labels)).select("doc_id", held_out, "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those the classifier rejects."""
    scored = with_quality(docs.withColumn("_doc", F.struct(*docs.columns)), fit_quality(docs, labels))
    return scored.where("predicted = 1").select("_doc.*")
