"""Line dedup and token counts against plain versions."""

import duckdb
import pytest

from roadplan.llm import lines, token_counts
from roadplan.llm.queries import TOKENIZER

TEXTS = [
    "a  b", "  ", "\n\n a ", "日本 語\n", "😀😀 a", " a", "a ", "x▁y", "The quick brown fox.\nAnd " * 40, "a" * 5000,
    "é" * 300, "\t\x0b", "end\n",
]


@pytest.fixture(scope="module")
def vocabulary():
    return token_counts.read_vocabulary(TOKENIZER)


def library_counts(texts, vocabulary):
    from tokenizers import Tokenizer, models

    pieces = [("<unk>", 0.0)] + [(f"<0x{b:02X}>", 0.0) for b in range(256)] + vocabulary.pieces
    low = min(s for _, s in vocabulary.pieces)
    model = models.Unigram([(p, s if i > 256 else low) for i, (p, s) in enumerate(pieces)], 0, True)
    return [len(Tokenizer(model).encode("▁" + t.replace(" ", "▁")).tokens) if t else 0 for t in texts]


def test_counts_equal_the_library(vocabulary, spark, sf):
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    counter = token_counts.Counter(vocabulary)
    assert [counter.count(t) for t in texts] == library_counts(texts, vocabulary)


def brute_count(text, vocabulary):
    """Every path, by recursion from the end; ties to the longest last piece."""
    scores = dict(vocabulary.pieces)
    low = min(scores.values()) - token_counts.UNKNOWN_PENALTY
    best = [(0.0, 0, False)]
    text = "▁" + text.replace(" ", "▁")
    for end in range(1, len(text) + 1):
        found = None
        for start in range(end):
            piece = text[start:end]
            if piece in scores:
                new = (best[start][0] + scores[piece], best[start][1] + 1, False)
            elif len(piece) == 1:
                more = len(piece.encode()) if vocabulary.byte_pieces else not best[start][2]
                new = (best[start][0] + low, best[start][1] + more, True)
            else:
                continue
            if found is None or new[0] > found[0]:
                found = new
        best.append(found)
    return best[-1][1]


@pytest.mark.parametrize("byte_pieces", [True, False])
@pytest.mark.parametrize("extra", [[], [("b▁a", -1.0)], [("b\n", -1.0)]])
def test_ties_and_unknowns(byte_pieces, extra):
    pieces = [("a", -2.0), ("aa", -4.0), ("b", -2.0), ("ab", -4.0), ("▁", -1.0), ("▁a", -3.0), ("aab", -5.0)]
    vocabulary = token_counts.Vocabulary(pieces + extra, byte_pieces)
    counter = token_counts.Counter(vocabulary)
    for text in ["aab", "a b", "ab a", "aaaa", "zz a", "zézab", "b\na", "b\n\n a", "  a  b", "zz\nzz"]:
        assert counter.count(text) == brute_count(text, vocabulary), text


def test_rows_of_any_kind(spark, vocabulary):
    docs = spark.createDataFrame([(1, None, 5), (1, "", 6), (None, "a b", 7)], "doc_id long, text string, n_tokens int")
    found = token_counts.with_token_counts(docs, vocabulary)
    assert [tuple(r) for r in found.collect()] == [(1, None, 0), (1, "", 0), (None, "a b", 2)]
    assert token_counts.with_token_counts(docs.limit(0), vocabulary).collect() == []


def plain_lines(rows, min_docs):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if key(line):
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        all_lines = (text or "").split("\n")
        kept = [x for x in all_lines if len(holders.get(key(x), ())) < min_docs]
        out.append((i, "\n".join(kept), len(all_lines), len(all_lines) - len(kept)))
    return sorted(out, key=str)


def test_lines_equal_plain_version(spark):
    rows = [(i, f"Head\n own {i}\n\n  HEAD \t\nÄ{i % 2}\nfoot\x0c") for i in range(6)]
    rows += [(7, None), (8, ""), (9, "head"), (9, "head"), (10, "\n\n"), (11, "foot\nFoot\nfoot"), (None, "head\nx")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n_lines int, id int")
    for min_docs in (1, 3, 8, 9, 20):
        found = lines.drop_frequent_lines(docs, min_docs).select("doc_id", "text", "n_lines", "n_dropped")
        assert sorted(map(tuple, found.collect()), key=str) == plain_lines(rows, min_docs)
    assert lines.line_report(docs.limit(0)).collect() == []


def test_more_frequent_keys_than_are_broadcast(spark, monkeypatch):
    rows = [(i, f"Head\n own {i}\n\n  HEAD \t\nfoot\n{'x' * i}") for i in range(8)]
    rows += [(8, None), (None, "head\nx"), (None, ""), (9, "head"), (9, "head"), ((1 << 60) + 1, "foot\ny"), ((1 << 60) + 3, "y")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, _n int").repartition(3)
    monkeypatch.setattr(lines, "BROADCAST_ROWS", 0)
    for min_docs in (2, 3, 9):
        found = lines.drop_frequent_lines(docs, min_docs).select("doc_id", "text", "n_lines", "n_dropped")
        assert sorted(map(tuple, found.collect()), key=str) == plain_lines(rows, min_docs)


@pytest.mark.parametrize("most", [0, lines.BROADCAST_ROWS])
def test_texts_of_many_frequent_lines(spark, monkeypatch, most):
    """Twelve texts of 20,000 lines that all of them hold, and one line of their own."""
    import time

    monkeypatch.setattr(lines, "BROADCAST_ROWS", most)
    shared = "\n".join(f"line {k}" for k in range(20_000))
    docs = spark.createDataFrame([(i, f"{shared}\nown {i}\n{shared}") for i in range(12)], "doc_id long, text string")
    start = time.time()
    found = lines.drop_frequent_lines(docs.repartition(4)).collect()
    assert time.time() - start < 60
    assert sorted((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in found) == [
        (i, f"own {i}", 40_001, 40_000) for i in range(12)]


def test_other_columns_keep_their_values(spark):
    docs = spark.createDataFrame(
        [(i, f"head\nown {i}", f"n{i}", "d", None) for i in range(10)],
        "doc_id long, text string, n_lines string, n_dropped string, a long")
    found = lines.without_frequent_lines(docs)
    assert found.columns == docs.columns
    assert sorted(map(tuple, found.collect())) == [(i, f"own {i}", f"n{i}", "d", None) for i in range(10)]


def test_line_query_equals_sql(spark, sf):
    from roadplan.llm.queries import QUERIES, SQL

    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS FROM '{sf}/documents.parquet'")
    mine = QUERIES["op10_line_dedup"](spark, sf)
    theirs = duckdb.sql(SQL["op10_line_dedup"])
    assert mine.columns == theirs.columns
    assert sorted(map(tuple, mine.collect())) == sorted(theirs.fetchall())
