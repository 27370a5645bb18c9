"""Repeated passages and benchmark overlaps against plain versions."""

import random

import numpy as np

from roadplan.llm import decontaminate, passages


def test_compact_windows_equal_recursion():
    rng = np.random.default_rng(0)
    for _ in range(30):
        first = np.concatenate(([0], np.cumsum(rng.integers(0, 60, 5))))
        values = rng.integers(0, 1 << 63, first[-1]).astype(np.uint64)
        width, want = int(rng.integers(1, 12)), set()

        def grow(left, right):
            if right - left >= width:
                node = left + int(np.argmin(values[left:right] >> np.uint64(26)))
                want.add((node, left, right))
                grow(left, node)
                grow(node + 1, right)

        for a, b in zip(first, first[1:], strict=False):
            grow(int(a), int(b))
        assert set(zip(*(x.tolist() for x in passages.compact_windows(values, first, width)), strict=True)) == want


def planted(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(3000)]
    shared = rng.choices(words, k=80)
    near = list(shared)
    near[10], near[70] = "x", "y"
    rows = []
    for i in range(40):
        own = rng.choices(words, k=rng.choice([20, 60, 400]))
        at = rng.randrange(len(own))
        if i in (5, 17, 30):
            own[at:at] = shared
        elif i == 33:
            own[at:at] = near
        elif i in (21, 22):
            own[at:at] = shared[:30]
        rows.append((i, " ".join(own)))
    rows += [(50, rows[2][1]), (51, None), (52, ""), (None, rows[5][1]), (53, rows[8][1] + "\n" + " ".join(shared).upper())]
    return rows + [rows[5]]


def test_planted_passages_are_found(spark):
    rows = planted(4)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start int").repartition(3)
    found = passages.repeats(docs).collect()
    text = {i: (t or "").lower().split() for i, t in rows}
    copy_long = {50} if len(text[2]) >= 50 else set()
    assert {r.doc_id for r in found} - {53 if len(text[8]) >= 50 else None} >= {17, 30, 33} | copy_long
    assert {r.doc_id for r in found} | {r.with_doc for r in found} <= {2, 5, 8, 17, 30, 33, 50, 53}
    for r in found:
        assert r.end - r.start >= 50 and r.doc_id > r.with_doc
        one = {tuple(text[r.doc_id][i:i + 5]) for i in range(r.start, r.end - 4)}
        two = {tuple(text[r.with_doc][i:i + 5]) for i in range(r.with_start, r.with_end - 4)}
        assert len(one & two) >= 0.8 * len(one | two)
    assert passages.repeats(docs.limit(0)).collect() == []


def plain_overlaps(rows, items):
    import re

    def split(t):
        return re.findall(r"[^\W_]+", (t or "").lower())

    out = {}
    for i, text in rows:
        words = split(text)
        for item, it in items:
            iw = split(it)
            if i is None or not iw:
                continue
            size = min(15, len(iw))
            masks = list(decontaminate.MASKS) + (["11111111"] if len(iw) < 12 else [])
            shifts = set()
            for m in masks:
                on = [k for k, c in enumerate(m) if c == "1"]
                for a in range(len(words) - len(m) + 1):
                    for b in range(len(iw) - len(m) + 1):
                        if all(words[a + k] == iw[b + k] for k in on):
                            shifts.add(a - b)
            if len(iw) < 8:
                shifts = set(range(len(words)))
            for s in shifts:
                for b in range(max(0, -s), min(len(iw), len(words) - s) - size + 1):
                    n = sum(words[b + s + k] == iw[b + k] for k in range(size))
                    if n >= -(-size * 4 // 5):
                        best = (n, -(b + s), -b, size)
                        out[i, item] = max(out.get((i, item), best), best)
    return {k: (n, size, -a, -b) for k, (n, a, b, size) in out.items()}


def test_overlaps_equal_plain_version(spark):
    rng = random.Random(6)
    words = [f"t{k}" for k in range(200)]
    items = [(k, " ".join(rng.choices(words, k=n))) for k, n in enumerate([5, 8, 10, 15, 30, 50])] + [(9, None), (10, "")]
    rows = []
    for i in range(60):
        own = rng.choices(words, k=rng.choice([3, 20, 120]))
        if i % 2:
            put = rng.choice(items[:6])[1].split()
            for _ in range(rng.choice([0, 0, 1, 3, 9])):
                put[rng.randrange(len(put))] = "sub"
            at = rng.randrange(len(own))
            own[at:at] = put
        rows.append((i, ", ".join(own)))
    rows += [(90, None), (91, ""), (None, items[4][1]), (92, "Intro! " + items[4][1].upper().replace(" ", "-"))]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(k, t, 2) for k, t in items], "item_id long, text string, doc_id int")
    found = {(r.doc_id, r.item_id): tuple(r)[2:] for r in decontaminate.overlaps(docs, bench).collect()}
    assert found == plain_overlaps(rows, items) and (92, 4) in found
    kept = {r.doc_id for r in decontaminate.without_overlaps(docs, bench).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _ in found}
    assert decontaminate.overlaps(docs.limit(0), bench).collect() == []
    assert decontaminate.overlaps(docs, bench.limit(0)).collect() == []
