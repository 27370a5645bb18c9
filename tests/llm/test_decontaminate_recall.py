"""No overlap may be lost to the seeds: masks over all patterns, and overlaps against a comparison of all windows."""

import itertools
import random

import pytest

from roadplan.llm import decontaminate


def lost(masks, size, unequal):
    """Patterns of so many unequal words in a window of ``size`` that no mask hits."""
    seeds = [{at + k for k, c in enumerate(m) if c == "1"} for m in masks for at in range(size - len(m) + 1)]
    return [p for p in itertools.combinations(range(size), unequal) if not any(s.isdisjoint(p) for s in seeds)]


@pytest.mark.parametrize("size, unequal", [(8, 1), (9, 1), (10, 2), (11, 2), (12, 2), (13, 2), (14, 2), (15, 3)])
def test_masks_hit_every_permitted_pattern(size, unequal):
    assert size - unequal == -(-size * 4 // 5)
    masks = decontaminate.SHORT_MASKS if size < decontaminate.SHORT else decontaminate.LONG_MASKS
    assert lost(masks, size, unequal) == []


def every_window(rows, items):
    """Overlaps by comparing all windows at all shifts, without seeds."""
    out = {}
    for (i, text), (item, it) in itertools.product(rows, items):
        words, iw = text.split(), it.split()
        size = min(15, len(iw))
        for a in range(len(words) - size + 1):
            for b in range(len(iw) - size + 1):
                n = sum(words[a + k] == iw[b + k] for k in range(size))
                if n >= -(-size * 4 // 5):
                    out[i, item] = max(out.get((i, item), (0,)), (n, -a, -b, size))
    return {k: (n, size, -a, -b) for k, (n, a, b, size) in out.items()}


def substituted(sizes, seed):
    """Items of the given sizes, and for each pattern of permitted substitutions (at most 150) a row."""
    rng = random.Random(seed)
    items = [(k, " ".join(f"i{k}w{j}" for j in range(n))) for k, n in enumerate(sizes)]
    rows = []
    for _, it in items:
        words = it.split()
        size = min(15, len(words))
        patterns = list(itertools.combinations(range(size), size - -(-size * 4 // 5)))
        for p in rng.sample(patterns, min(150, len(patterns))):
            copy = ["sub" if k in p or k >= 15 else w for k, w in enumerate(words)]
            rows.append((len(rows), " ".join(["before"] * rng.randrange(4) + copy + ["after"] * rng.randrange(4))))
    return rows, items


def found(spark, rows, items):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): tuple(r)[2:] for r in decontaminate.overlaps(docs, bench).collect()}


def test_items_of_twelve_and_more_words_equal_all_windows(spark):
    rows, items = substituted([12, 13, 14, 15, 20], 1)
    want = every_window(rows, items)
    assert len(want) == len(rows) and found(spark, rows, items) == want


def test_items_of_eight_to_eleven_words_equal_all_windows(spark):
    rows, items = substituted([8, 9, 10, 11], 2)
    want = every_window(rows, items)
    assert len(want) == len(rows) and found(spark, rows, items) == want


def test_items_of_one_to_seven_words_equal_all_windows(spark):
    rows, items = substituted([1, 2, 3, 4, 5, 6, 7], 3)
    want = every_window(rows, items)
    assert len(want) == len(rows) and found(spark, rows, items) == want


def test_short_and_long_items_together(spark):
    items = [(1, "one"), (2, "two words"), (3, "a b c d e f g"), (4, ""), (5, " ".join(f"l{k}" for k in range(20)))]
    rows = [(1, "no such thing"), (2, "One, two words; two words"), (3, "a b c d e x g"), (4, "z a b c d e f g one"),
            (5, ""), (6, items[4][1] + " one"), (7, "a b x d e y g"), (8, "b c d e f g")]
    want = {(2, 1): (1, 1, 0, 0), (2, 2): (2, 2, 1, 0), (3, 3): (6, 7, 0, 0), (4, 1): (1, 1, 8, 0), (4, 3): (7, 7, 1, 0),
            (6, 1): (1, 1, 20, 0), (6, 5): (15, 15, 0, 0)}
    assert found(spark, rows, items) == want
    assert found(spark, rows, items[:3]) == {k: v for k, v in want.items() if k[1] < 4}
