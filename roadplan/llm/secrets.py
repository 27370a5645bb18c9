"""Secret scans: three patterns, and a token-efficiency test for random strings.

A tokenizer made for text spends few tokens on words and many on random strings. Every run of ``LEAST_CHARS`` or more
letters, digits and ``+/_=-`` that no pattern has claimed is divided into tokens; one that gets fewer than ``RATIO``
characters a token is exposed as random, unless it has the form of a digest, of a UUID or number, or of an
identifier: parts of letters that a case change, digit, or sign sets apart and that the tokenizer knows well.

Runs of characters are found in numpy over the bytes of many texts at once; the patterns run only over texts that hold one of
their fixed words.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadplan.llm.words import batches

#: Fixed patterns. Letters of the first group's words match in either case, ASCII only.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_WORD = b"AKIA"
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: The patterns' kinds in the order in which spans of one start are listed; the test's kind comes last.
KINDS = ("assign", "access", "hex", "random")
LEAST_CHARS, RATIO = 20, 1.8
#: Forms of known digests (lengths in hexadecimal digits), UUIDs and numbers.
DIGESTS = (32, 40, 56, 64, 96, 128)
PLAIN = re.compile(
    r"(?:[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}|[0-9]+(?:[-_/+=][0-9]+)*|(.)\1*|[-_=+/]*)", re.IGNORECASE | re.ASCII)
#: Parts of an identifier, and how well a tokenizer must know its letters (characters a token) for it to be one.
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
NAME_RATIO = 2.5

_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_RUN = np.zeros(256, bool)
_RUN[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-")] = True

FOUND = "array<struct<kind:string,start:int,end:int,ratio:double>>"


@lru_cache(maxsize=4)
def read_ranks(path: str) -> bytes:
    """The vocabulary file's content: a base64 token and its rank on each line."""
    with open(path, "rb") as file:
        return file.read()


@lru_cache(maxsize=2)
def encoding(content: bytes, pattern: str):
    """The tokenizer; built once in each Python worker."""
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}
    return tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def runs(data: np.ndarray, member: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(start, end) of the longest stretches of ``least`` or more bytes that belong to ``member``."""
    inside = np.concatenate(([False], member[data], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= least
    return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))


def base_spans(text: str, data: bytes, hex_runs: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the three patterns; ``hex_runs`` are already in code points."""
    found = [("hex", a, b) for a, b in hex_runs]
    low = data.lower()
    if any(word in low for word in ASSIGN_WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if ACCESS_WORD in data:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    return found


def known_form(run: str, tokens) -> bool:
    """Whether a run is a digest, UUID, number, repetition, or an identifier made of words."""
    if PLAIN.fullmatch(run) or len(run) in DIGESTS and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", run):
        return True
    parts = [p for p in PART.findall(run) if p.isalpha()]
    letters = sum(map(len, parts))
    if not parts or letters < 0.6 * len(run) or letters / len(parts) < 3:
        return False
    return letters >= NAME_RATIO * sum(len(tokens(p.lower())) for p in parts)


def characters_a_token(run: str, tokens) -> float:
    return len(run) / max(1, len(tokens(run)))


def scan(texts: list[str], tokens, least_chars: int = LEAST_CHARS, ratio: float = RATIO) -> list[list[tuple]]:
    """For each text the spans (kind, start, end, characters a token or None), by start, then kind as listed."""
    out = []
    for i, j in batches(texts):
        parts = [text.encode("utf-8", "replace") for text in texts[i:j]]
        first = np.cumsum([0] + [len(p) + 1 for p in parts])
        data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        by_text: dict[int, tuple[list, list]] = {}
        for which, (member, least) in enumerate(((_HEX, LEAST["hex"]), (_RUN, least_chars))):
            for a, b in runs(data, member, least):
                at = int(np.searchsorted(first, a, "right")) - 1
                # runs are ASCII: only what stands before them can be longer in bytes than in code points
                start = len(parts[at][: a - first[at]].decode("utf-8", "replace"))
                by_text.setdefault(at, ([], []))[which].append((start, start + b - a))
        for k, text in enumerate(texts[i:j]):
            hex_runs, long_runs = by_text.get(k, ((), ()))
            spans = [(*s, None) for s in base_spans(text, parts[k], list(hex_runs))]
            claimed = sorted((a, b) for _, a, b, _ in spans)
            for a, b in long_runs:
                if not any(c < b and a < d for c, d in claimed):
                    value = characters_a_token(text[a:b], tokens)
                    if value < ratio and not known_form(text[a:b], tokens):
                        spans.append(("random", a, b, value))
            out.append(sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))))
    return out


def with_secrets(
    docs: DataFrame, vocabulary: str, pattern: str, least_chars: int = LEAST_CHARS, ratio: float = RATIO,
    text_col: str = "text", name: str = "secrets",
) -> DataFrame:
    """``docs`` with ``name``: an array of (kind, start, end, ratio), by start, then kind as listed in ``KINDS``.

    Places are code points, ends exclusive. Spans of the patterns ("assign", "access", "hex") don't overlap others
    of their kind, but may overlap another kind's; ``ratio`` is theirs null. Random strings overlap none of them.
    Null and empty texts have an empty array; a very long text is scanned whole; repeated rows are each scanned; a column
    called ``name`` is replaced, all others are passed on. An empty table gives an empty table.
    ``vocabulary`` is the path of a tiktoken file, read by the driver and sent to the tasks, ``pattern`` its splitting pattern.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    @F.pandas_udf(FOUND)
    def find(texts: pd.Series) -> pd.Series:
        tokens = encoding(shared.value, pattern).encode_ordinary
        found = scan([t or "" for t in texts], tokens, least_chars, ratio)
        return pd.Series([
            [{"kind": k, "start": a, "end": b, "ratio": r} for k, a, b, r in spans] for spans in found], dtype=object)

    return docs.withColumn(name, find(F.col(text_col)))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_report(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Counts and digests of the patterns' spans, and all spans as text; one row per row of ``docs``."""
    found = with_secrets(docs.select("doc_id", "text"), vocabulary, pattern, name="_secrets")
    spans = F.col("_secrets")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(kind) for kind in ("assign", "access", "hex")], count("random"),
        F.sha2(_listed(F.filter(spans, lambda s: s["kind"] != "random")), 256).alias("base_sha256"),
        _listed(spans).alias("spans"))
