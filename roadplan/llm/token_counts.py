"""Token counts of a unigram vocabulary without building tokens.

An Aho-Corasick automaton lists the vocabulary pieces that end at each character; dynamic programming keeps, per
position, the best score and the number of pieces on the way there. Rules, as in the usual unigram tokenizers: scores
add up in double precision; of equal scores the longest last piece wins; a character that is no piece costs the least
score minus ten and counts one piece per UTF-8 byte where the vocabulary has byte pieces, else one per run of such
characters. Blanks become U+2581 and one is put in front of a text that isn't empty.

No piece has the blank mark after another character in the vocabularies in use (checked when it is read; else whole
texts are one stretch), so a text falls into stretches of blanks and what follows them, whose best paths don't depend on
each other. Stretches are looked up in a bounded table first, which only saves time.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
UNKNOWN_PENALTY = 10.0
#: Stretches remembered per Python worker, and the longest that is remembered.
TABLE_ENTRIES, TABLE_CHARS = 1_000_000, 40


class Vocabulary(NamedTuple):
    """Pieces with their scores; ``byte_pieces`` says whether unknown characters fall apart into bytes."""

    pieces: list[tuple[str, float]]
    byte_pieces: bool


def read_vocabulary(path: str) -> Vocabulary:
    """Pieces and scores of a sentencepiece model file, whatever kind it was trained as; read on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = [i for i in ids if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i))]
    return Vocabulary(
        [(model.id_to_piece(i), float(model.get_score(i))) for i in plain], any(model.is_byte(i) for i in ids))


class Counter(dict):
    """Maps a stretch to its number of pieces."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {piece for piece, _ in vocabulary.pieces if len(piece) == 1}
        self.unknown = min((s for _, s in vocabulary.pieces), default=0.0) - UNKNOWN_PENALTY
        self.byte_pieces = vocabulary.byte_pieces
        self.apart = not any(BLANK in piece.lstrip(BLANK) for piece, _ in vocabulary.pieces)
        # a line break that no piece holds is a piece of its own on every path
        self.lines = self.byte_pieces and not any("\n" in piece for piece, _ in vocabulary.pieces)

    def matches(self, stretch: str) -> Iterator[tuple[int, tuple[int, float]]]:
        """(last position, (length, score)), by end, the longest first; unknown characters have length 0."""
        if self.single.issuperset(stretch):
            return self.automaton.iter(stretch)
        found = [(last, -length, score) for last, (length, score) in self.automaton.iter(stretch)]
        found += [(i, 0, self.unknown) for i, ch in enumerate(stretch) if ch not in self.single]
        return ((last, (-length, score)) for last, length, score in sorted(found))

    def path(self, stretch: str) -> tuple[int, float]:
        """Pieces and score of the best path."""
        n = len(stretch)
        best, count, unknown = [0.0] + [-math.inf] * n, [0] * (n + 1), set()
        for last, (length, worth) in self.matches(stretch):
            start = last + 1 - (length or 1)
            score = best[start] + worth
            if score > best[last + 1]:
                best[last + 1] = score
                if length:
                    count[last + 1] = count[start] + 1
                else:
                    count[last + 1] = count[start] + self.pieces_of_unknown(stretch[last], start in unknown)
                    unknown.add(last + 1)
        return count[n], best[n]

    def pieces_of_unknown(self, ch: str, goes_on: bool) -> int:
        return len(ch.encode("utf-8", "replace")) if self.byte_pieces else int(not goes_on)

    def __missing__(self, stretch: str) -> int:
        found = self.path(stretch)[0]
        if len(stretch) <= TABLE_CHARS:
            if len(self) >= TABLE_ENTRIES:
                self.clear()
            self[stretch] = found
        return found

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = " " + text.replace(BLANK, " ")
        breaks = text.count("\n") if self.lines else 0
        if not self.apart:
            text = text.replace(" ", BLANK)
            stretches = text.split("\n") if self.lines else [text]
        elif "  " in text:
            pattern = " +[^ \n]*|[^ \n]+" if self.lines else " +[^ ]*|[^ ]+"
            stretches = [s.replace(" ", BLANK) for s in re.findall(pattern, text)]
        elif self.lines:
            stretches = text.replace(" ", "\n" + BLANK).split("\n")
        else:
            stretches = text.replace(" ", " " + BLANK).split(" ")
        return sum(map(self.__getitem__, filter(None, stretches))) + breaks


_counters: dict[int, Counter] = {}


def counter_of(vocabulary: Vocabulary) -> Counter:
    """One counter per Python worker, kept from task to task; another vocabulary takes its place."""
    key = hash((tuple(vocabulary.pieces), vocabulary.byte_pieces))
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(vocabulary)
    return _counters[key]


def with_token_counts(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, the pieces on the best path.

    Null and empty texts have none. Every row is returned; a column of this name is replaced, all others are passed on.
    The vocabulary is the only thing sent to all tasks; its size doesn't depend on the data.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("long")
    def counted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = counter_of(shared.value)
        for texts in parts:
            yield pd.Series([counter.count(t) for t in texts], dtype="int64")

    return docs.withColumn("n_tokens", counted(text_col))
