import random

import pytest

from roadplan.operators.crossings import river_segments
from roadplan.operators.network import adjacency_lists
from roadplan.operators.sequence import number_rows, with_next


@pytest.mark.parametrize("hot_rows", [10, 10_000])
def test_numbers_follow_the_order(spark, hot_rows):
    r = random.Random(2)
    rows = [(0 if r.random() < 0.6 else r.randrange(1, 40), r.randrange(50), i) for i in range(600)]
    df = spark.createDataFrame(rows, "k int, a int, b int")
    got = {(x.k, x.a, x.b): x.pos for x in number_rows(df, "k", ["a", "b"], "pos", hot_rows).collect()}
    want = {}
    for k in {x[0] for x in rows}:
        for i, row in enumerate(sorted(x for x in rows if x[0] == k)):
            want[row] = i
    assert got == want


def test_successors_over_gaps_in_keys_of_any_size(spark):
    rows = [(k, 3 * n + k, f"{k}-{n}") for k in range(3) for n in range(5 + 40 * k)]
    want = sorted((k, o, v, rows[i + 1][2] if i + 1 < len(rows) and rows[i + 1][0] == k else None)
                  for i, (k, o, v) in enumerate(rows))
    df = spark.createDataFrame(rows, "k int, o int, v string").repartition(5)
    for hot in (10, 60, 1000):
        found = with_next(df, "k", "o", ["v"], hot_rows=hot).select("k", "o", "v", "next_v").collect()
        assert sorted(map(tuple, found), key=lambda r: r[:2]) == want


def test_a_river_with_a_gap_keeps_its_segments(spark):
    vertices = spark.createDataFrame(
        [(7, None, s, 30.0 + s, 78.0) for s in (4, 0, 3, 1)], "river_id long, name string, seq long, lat double, lon double")
    found = river_segments(vertices).collect()
    assert sorted((r.river_seg, r.lat1, r.lat2, r.river_name) for r in found) == [
        (0, 30.0, 31.0, "Unnamed River"), (1, 31.0, 33.0, "Unnamed River"), (3, 33.0, 34.0, "Unnamed River")]


def test_hub_nodes_are_split(spark):
    edges = spark.createDataFrame([(f"e{k}", 1, k) for k in range(2, 102)] + [("x", 2, 1)], "edge_id string, source long, target long")
    lists = adjacency_lists(edges, list_edges=20).collect()
    hub = [r for r in lists if r.node_id == 1]
    assert len(hub) > 3 and all(len(r.out) < 40 for r in hub)
    assert sorted(e.edge_id for r in hub for e in r.out) == sorted(f"e{k}" for k in range(2, 102))
    assert [(e.edge_id, e.node) for r in hub for e in r.into] == [("x", 2)]
    assert {(r.node_id, len(r.out), len(r.into)) for r in lists if r.node_id in (2, 3)} == {(2, 1, 1), (3, 0, 1)}
