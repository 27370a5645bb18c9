"""Language of texts that may switch language: a linear-chain conditional random field over words.

A word's evidence is the sum of learned weights of its byte n-grams (those that touch a word end are its affixes) and of
the word itself (a learned lexicon); learned transitions tie neighbouring words together. Forward-backward gives each
word's probabilities, and a document's language is the one with most of them over all its words that have letters.

Chains are lines; a line of more than ``CHAIN_WORDS`` words is several chains. Whole texts are labelled. The fit uses a sample
of about ``SAMPLE_ROWS`` documents and ``SAMPLE_CHARS`` characters; its training chains join stretches of
documents in different languages, so that transitions are learned from switches as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadplan.llm.quality import remainder, sampled
from roadplan.llm.words import batches, mix, span_hashes, word_spans

SAMPLE_ROWS, SAMPLE_CHARS = 1_500, 3_000_000
CHAIN_WORDS = 256
GRAMS = (1, 2, 3, 4)
BUCKETS = 1 << 16
UNKNOWN = "und"
_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    """Whether a character of the text is a letter; numbers written as signs are not."""
    return _ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text))


class Words:
    """Features of all words of a batch: (word, bucket) pairs grouped by word, chains as stretches of word numbers."""

    def __init__(self, texts: list[str]):
        data, self.starts, self.ends, self.first = word_spans(texts)
        self.n = len(self.starts)
        space = (data <= 32) & ((data == 32) | (data >= 9) & (data <= 13))
        begin = np.zeros(len(data), np.int64)
        begin[self.starts] = 1
        word = np.cumsum(begin) - 1
        self.grams = []
        for n in GRAMS:
            size = len(data) - n + 1
            ok = ~space[:size] if n == 1 else ~(space[:size] & space[n - 1:])
            code = np.zeros(max(size, 0), np.uint64)
            for k in range(n):
                code = code * np.uint64(257) + data[k: k + size] + np.uint64(1)
                if 0 < k < n - 1:
                    ok = ok & ~space[k: k + size]
            if n == 2:
                ok = ~(space[:-1] & space[1:])
            at = np.flatnonzero(ok)
            owner = word[at + space[at]] if len(at) else at
            self._add(owner, mix(code[at] + np.uint64(n << 40)))
        self._add(np.arange(self.n), mix(span_hashes(data, self.starts, self.ends) + np.uint64(5)))
        letter = (data >= 97) & (data <= 122) | (data >= 128)
        counts = np.concatenate(([0], np.cumsum(letter)))
        self.lettered = counts[self.ends] > counts[self.starts]
        breaks = np.concatenate(([0], np.cumsum(data == 10)))[self.starts]
        text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.text = text
        new = np.ones(self.n, bool)
        new[1:] = (breaks[1:] != breaks[:-1]) | (text[1:] != text[:-1])
        heads = np.flatnonzero(new)
        since = np.arange(self.n) - np.repeat(heads, np.diff(np.append(heads, self.n)))
        self.heads = np.flatnonzero(since % CHAIN_WORDS == 0)

    def _add(self, owner: np.ndarray, hashes: np.ndarray) -> None:
        if len(owner):
            cut = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            self.grams.append((owner[cut], cut, (hashes % np.uint64(BUCKETS)).astype(np.int32), owner))

    def evidence(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, weights.shape[1]), np.float32)
        for owner, cut, bucket, _ in self.grams:
            out[owner] += np.add.reduceat(weights[bucket], cut, axis=0)
        out[~self.lettered] = 0
        return out


class Chains:
    """Word numbers laid out by time, so that all chains step together without padding."""

    def __init__(self, heads: np.ndarray, lengths: np.ndarray):
        order = np.argsort(-lengths, kind="stable")
        heads, lengths = heads[order], lengths[order]
        self.steps = int(lengths[0]) if len(lengths) else 0
        self.active = np.searchsorted(-lengths, -np.arange(self.steps), side="left")
        self.offset = np.concatenate(([0], np.cumsum(self.active)))
        self.place = np.concatenate(
            [heads[:a] + t for t, a in enumerate(self.active)]) if self.steps else np.zeros(0, np.int64)

    def forward_backward(self, evidence: np.ndarray, transitions: np.ndarray, pairs: bool = False):
        """Probabilities of each placed word, and the expected transitions if asked for."""
        e = evidence[self.place]
        e = np.exp(e - e.max(axis=1, keepdims=True)).astype(np.float64)
        k = transitions.shape[0]
        step = np.exp(transitions - transitions.max())
        alpha, beta = np.empty_like(e), np.ones_like(e)
        for t in range(self.steps):
            now = slice(self.offset[t], self.offset[t + 1])
            a = e[now]
            if t:
                before = alpha[self.offset[t - 1]: self.offset[t - 1] + self.active[t]]
                a = (before @ step) * a
            alpha[now] = a / a.sum(axis=1, keepdims=True)
        expected = np.zeros((k, k))
        for t in range(self.steps - 2, -1, -1):
            n = self.active[t + 1]
            after = e[self.offset[t + 1]: self.offset[t + 2]] * beta[self.offset[t + 1]: self.offset[t + 2]]
            b = after @ step.T
            here = slice(self.offset[t], self.offset[t] + n)
            if pairs:
                joint = alpha[here][:, :, None] * step * after[:, None, :]
                expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            beta[here] = b / b.sum(axis=1, keepdims=True)
        p = alpha * beta
        return p / p.sum(axis=1, keepdims=True), expected


class LanguageModel:
    def __init__(self, languages: list[str], weights: np.ndarray, transitions: np.ndarray):
        self.languages, self.weights, self.transitions = languages, weights, transitions

    def word_probabilities(self, words: Words) -> np.ndarray:
        chains = Chains(words.heads, np.diff(np.append(words.heads, words.n)))
        out = np.empty((words.n, len(self.languages)))
        out[chains.place] = chains.forward_backward(words.evidence(self.weights), self.transitions)[0]
        return out

    def label(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        names, scores = [], np.zeros(len(texts))
        for i, j in batches(texts, 1 << 19):
            words = Words(texts[i:j])
            p = self.word_probabilities(words) * words.lettered[:, None] if words.n else np.zeros((0, len(self.languages)))
            total = np.column_stack([np.bincount(words.text, p[:, k], j - i) for k in range(len(self.languages))])
            best = total.argmax(axis=1)
            count = np.maximum(total.sum(axis=1), 1e-9)
            for t in range(i, j):
                known = has_letter(texts[t]) and total[t - i].sum() > 0
                names.append(self.languages[best[t - i]] if known else UNKNOWN)
                scores[t] = min(1.0, total[t - i].max() / count[t - i]) if known else 0.0
        return names, scores


def fit_crf(texts: list[str], truth: np.ndarray, languages: list[str], epochs: int = 4, rate: float = 0.3) -> LanguageModel:
    """Weights and transitions that maximise the likelihood of the words' languages, by AdaGrad over groups of chains."""
    k, random = len(languages), np.random.default_rng(7)
    weights, transitions = np.zeros((BUCKETS, k), np.float32), np.zeros((k, k))
    seen_w, seen_t = np.full((BUCKETS, k), 1e-2, np.float32), np.full((k, k), 1e-2)
    order = random.permutation(len(texts))
    groups = list(batches([texts[i] for i in order], 1 << 17))
    for epoch in range(epochs):
        for i, j in groups:
            chosen = order[i:j]
            words = Words([texts[t] for t in chosen])
            if not words.n:
                continue
            label = truth[chosen][words.text]
            # stretches of lines in random order, two or three to a chain
            cuts = np.union1d(words.heads, random.choice(words.n, words.n // 12 + 1))
            lengths = np.diff(np.append(cuts, words.n))
            shuffled = random.permutation(len(cuts))
            moved = np.concatenate([np.arange(cuts[s], cuts[s] + lengths[s]) for s in shuffled])
            ends = np.cumsum(lengths[shuffled])
            heads = np.concatenate(([0], ends[:-1]))[:: 2 + epoch % 2]
            chains = Chains(heads, np.diff(np.append(heads, len(moved))))
            p, expected = chains.forward_backward(words.evidence(weights)[moved], transitions, True)
            gradient = np.empty((words.n, k))
            gradient[moved[chains.place]] = p
            gradient[np.arange(words.n), label] -= 1
            gradient[~words.lettered] = 0
            observed = np.zeros((k, k))
            inside = np.ones(len(moved), bool)
            inside[heads] = False
            at = np.flatnonzero(inside)
            np.add.at(observed, (label[moved[at - 1]], label[moved[at]]), 1)
            g = (expected - observed) / len(moved) + 1e-3 * transitions
            seen_t += g * g
            transitions = transitions - rate * g / np.sqrt(seen_t)
            g = np.zeros((BUCKETS, k), np.float32)
            for _, _, bucket, owner in words.grams:
                for c in range(k):
                    g[:, c] += np.bincount(bucket, gradient[owner, c], BUCKETS)
            g = g / np.sqrt(words.n) + 1e-4 * weights
            seen_w += g * g
            weights = weights - np.float32(rate) * g / np.sqrt(seen_w)
    return LanguageModel(languages, weights.astype(np.float32), transitions)


def fit_language(docs: DataFrame) -> LanguageModel:
    """Fit on (doc_id, text, lang) rows with a language whose crc32 remainder isn't 2; languages are all values there.

    Null ids and null languages aren't learned from. Without any row to learn from every text is ``und``.
    """
    rows = docs.where((remainder("doc_id") != 2) & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    languages = sorted(r.lang for r in rows.groupBy("lang").count().collect())
    sample = [(r.text or "", r.lang) for r in sampled(rows, SAMPLE_ROWS, SAMPLE_CHARS, 3).select("text", "lang").collect()]
    if not sample:
        return LanguageModel([UNKNOWN], np.zeros((BUCKETS, 1), np.float32), np.zeros((1, 1)))
    number = {name: i for i, name in enumerate(languages)}
    return fit_crf([t for t, _ in sample], np.array([number[x] for _, x in sample]), languages)


def with_language(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the share of the words' probability.

    Texts that are null or have no letter are ``und`` with score 0. Columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def labelled(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            names, scores = shared.value.label([t or "" for t in texts])
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.withColumn("_labelled", labelled(text_col)).select(*kept, "_labelled.lang_pred", "_labelled.score")


def language_report(docs: DataFrame) -> DataFrame:
    held_out = F.coalesce(remainder("doc_id") == 2, F.lit(False)).alias("held_out")
    return with_language(docs.select("doc_id", "text"), fit_language(docs)).select(
        "doc_id", held_out, "lang_pred", "score")
