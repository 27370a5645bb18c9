"""Words and word shingles of many texts at once, as 64-bit hashes in numpy arrays.

A word is a maximal run of bytes other than ASCII white space in the lower-cased UTF-8 text. A shingle is a run of five
words; a text of one to four words has one shingle, all its words; a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SHINGLE = 5
#: Bytes of text handled at once; a longer text is handled alone.
BATCH_BYTES = 1 << 21

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = n + n // 4
        for k, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers


def batches(texts: list[str], size: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` characters."""
    start = total = 0
    for i, text in enumerate(texts):
        if total and total + len(text) > size:
            yield start, i
            start, total = i, 0
        total += len(text)
    if start < len(texts):
        yield start, len(texts)


def word_spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the lower-cased texts between blanks, starts and ends of words in them, first word of each text."""
    parts = [text.lower().encode("utf-8", "replace") for text in texts]
    data = np.frombuffer(b" " + b" ".join(parts) + b" ", np.uint8)
    space = _SPACE[data]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    begins = np.cumsum([1] + [len(p) + 1 for p in parts])
    return data, starts, ends, np.searchsorted(starts, begins)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    powers, inverses = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * powers[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverses[starts])


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the first word of each text with the total count at the end."""
    data, starts, ends, first = word_spans(texts)
    return span_hashes(data, starts, ends), first


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in order, repeats included, and the first shingle of each text."""
    counts = np.diff(first)
    per_text = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    out_first = np.concatenate(([0], np.cumsum(per_text)))
    text = np.repeat(np.arange(len(counts)), per_text)
    at = first[:-1][text] + np.arange(out_first[-1]) - out_first[:-1][text]
    length = np.minimum(counts[text], size)
    padded = np.concatenate((hashes, np.zeros(size, np.uint64)))
    total = length.astype(np.uint64)
    for j in range(size):
        word = np.where(j < length, padded[at + j], np.uint64(0))
        total = total * np.uint64(_BASE) + word
    return mix(total), out_first


def shingle_sets(texts: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and where each text's begin."""
    hashes, first = shingle_hashes(*word_hashes(texts), size)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], np.searchsorted(text[new], np.arange(len(texts) + 1))
