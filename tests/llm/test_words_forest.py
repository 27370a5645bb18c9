"""Shingles, the forest join and components against brute force."""

import random

import pytest

from roadplan.llm.components import components
from roadplan.llm.forest import forest_depth, near_duplicates
from roadplan.llm.words import shingle_sets, word_hashes

SCHEMA = "doc_id long, text string, class_id string, root int"


def plain_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_classes(rows, threshold=0.8):
    """{id: (least id of the class, links)}"""
    sets = {i: plain_shingles(t) for i, t in rows}
    linked = {i: {j for j in sets if j != i and sets[i] and sets[j]
                  and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])} for i in sets}
    root = {}
    for i in sorted(sets):
        todo = [] if i in root else [i]
        while todo:
            j = todo.pop()
            if j not in root:
                root[j] = i
                todo += linked[j]
    return {i: (root[i], len(linked[i])) for i in sets}


def made_documents(n, seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            text = (rng.choice(rows)[1] or "").split(" ")
            for _ in range(rng.choice([0, 0, 1, 2])):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((i, " ".join(text)))
        else:
            rows.append((i, " ".join(rng.choices(words, k=rng.choice([1, 3, 5, 60, 200])))))
    return rows


def test_words_do_not_depend_on_place_or_blanks():
    one, first = word_hashes(["a bc  D", "", "bc\ta", None or "d"])
    assert list(first) == [0, 3, 3, 5, 6]
    assert one[0] == one[4] and one[1] == one[3] and one[2] == one[5] and len(set(one)) == 3


def test_shingle_counts():
    texts = ["", " \n", "a", "a b c d e", "a b c d e f f f f f f f f", "ü é"]
    _, first = shingle_sets(texts)
    assert [b - a for a, b in zip(first, first[1:])] == [len(plain_shingles(t)) for t in texts]


def test_depth_reaches_recall():
    depth = forest_depth(0.8, 0.999, 16, 8)
    assert 1 - (1 - 0.8**depth) ** 16 >= 0.999 > 1 - (1 - 0.8 ** (depth + 1)) ** 16


@pytest.mark.parametrize("block", [512, 7])
def test_classes_and_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr("roadplan.llm.forest.BLOCK_ENTRIES", block)
    rows = made_documents(150, 5) + [(1000, None), (1001, ""), (1002, " \n "), (1003, "x"), (1004, "X")]
    docs = spark.createDataFrame([(i, t, "other", 1) for i, t in rows], SCHEMA).repartition(4)
    found = {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates(docs).collect()}
    assert found == plain_classes(rows)


def test_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (3, "z")]
    docs = spark.createDataFrame([(i, t, None, 0) for i, t in rows], SCHEMA)
    found = sorted(map(tuple, near_duplicates(docs).collect()), key=str)
    assert found == [(1, 1, 1), (2, 1, 1), (3, 3, 0), (None, None, 0)]
    assert near_duplicates(docs.limit(0)).collect() == []


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(230)] + [(900 + i, 901 + i) for i in range(40)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    least = {n: n for e in edges for n in e}
    for _ in range(400):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    assert found == least
