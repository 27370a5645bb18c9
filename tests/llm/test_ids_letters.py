"""Ids beyond floating point next to a null id, and what counts as a letter."""

import pytest

from roadplan.llm import chat, forest, language, packing

BIG = 1 << 60


def test_near_duplicates_keep_large_ids(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(BIG + 1, text), (BIG + 3, text + " end"), (None, text), (BIG + 5, "other words"), (None, "other words"), (None, text)]
    found = forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted(map(tuple, found), key=str) == sorted(
        [(BIG + 1, BIG + 1, 1), (BIG + 3, BIG + 1, 1), (BIG + 5, BIG + 5, 0), (None, None, 0), (None, None, 0)], key=str)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_packing_keeps_large_ids(spark, kind):
    ids = [BIG + 1, BIG + 3, None, 0, None]
    rows = [(str(i) if kind == "string" and i is not None else i, "a b c") for i in ids]
    found = packing.packed_pieces(spark.createDataFrame(rows, f"doc_id {kind}, text string").coalesce(1)).collect()
    assert sorted((r.doc_id for r in found), key=str) == sorted((i for i, _ in rows), key=str)
    assert len({(r.bin_id, r.offset) for r in found}) == 5 and all(r.n_tokens == 3 for r in found)


def test_conversations_keep_large_ids(spark):
    rows = [(BIG + 1, 0, "user", "a"), (BIG + 2, 0, "user", "b"), (None, 0, "user", "c"), (0, 0, "user", "d"), (None, 1, "assistant", "e")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    assert {(r.conv_id, r.n_turns) for r in chat.format_report(turns).collect()} == {
        (BIG + 1, 1), (BIG + 2, 1), (None, 2), (0, 1)}
    assert {r.conv_id for r in chat.formatted_parts(turns).collect()} == {BIG + 1, BIG + 2, None, 0}


def test_letters():
    assert [language.has_letter(t) for t in ["", "1 2", "\u00bd \u00b2", "\u2460", "\u2163", "_", "a", "\u00e9", "\u65e5", "\u02b0 1"]] == [
        False, False, False, False, False, False, True, True, True, True]
