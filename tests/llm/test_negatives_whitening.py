"""Hard negatives and whitening against plain versions."""

import gc
import math
import time

import duckdb
import numpy as np
import pytest

from roadplan.llm import negatives, whitening
from roadplan.llm.queries import QUERIES, SQL

NAN, INF = float("nan"), float("inf")


def plain_mining(rows, every=4, positives=5, negatives=10):
    """rows: (id, label, vector); the same rules row by row."""
    kept = {(i, (l + 1) % 10 if i % 7 == 0 else l, tuple(math.floor(256 * x) for x in v))
            for i, l, v in rows if None not in (i, l, v) and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a in kept:
        if a[0] % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[2], b[2], strict=True)), b[0], b[1]) for b in kept)
        for s, p, _ in [x for x in scored if x[2] == a[1] and x[1] != a[0]][:positives]:
            rivals = [x for x in scored if x[2] != a[1] and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            out += [(a[0], p, k, x[1], -s, -x[0]) for k, x in enumerate(rivals, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [(16_384, 2_048), (40, 7)])
@pytest.mark.parametrize("seed", [1, 2])
def test_mining_equals_plain_version(spark, block, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(i), int(rng.integers(0, 3)), [float(x) for x in rng.normal(0.2, 0.3, 6)]) for i in range(150)]
    rows += [(200 + i, 1, [0.5] * 6) for i in range(40)]  # ties, one label in excess
    rows += [(300 + i, 2, [0.25] * 6) for i in range(20)] + [(340, 3, [-0.5] * 6), (344, 4, [0.0] * 6)]
    rows += [(400, None, [0.1] * 6), (404, 1, None), (408, 1, [NAN] + [0.0] * 5), (412, 1, [INF] + [0.0] * 5),
             (416, 1, [None] + [0.0] * 5), (None, 1, [0.1] * 6), (420, 0, [0.5] * 6), rows[4], rows[5], ((1 << 60) + 4, 1, [0.5] * 6)]
    docs = spark.createDataFrame(
        [(i, l, v, 0, 1) for i, l, v in rows], "vec_id long, label int, embedding array<double>, score int, q int").repartition(3)
    label = negatives.F.when(negatives.F.col("vec_id") % 7 == 0, (negatives.F.col("label") + 1) % 10).otherwise(negatives.F.col("label"))
    found = negatives.mine(docs, "vec_id % 4 = 0", label, block=block).collect()
    assert sorted(map(tuple, found)) == plain_mining(rows)


def test_mining_of_few_rows(spark):
    schema = "vec_id long, label int, embedding array<float>"
    assert negatives.mining_report(spark.createDataFrame([], schema)).collect() == []
    lone = spark.createDataFrame([(100, 1, [0.5]), (1, 2, [0.5]), (2, 2, [0.5, 0.5]), (101, 3, [0.25])], schema)
    assert negatives.mining_report(lone).collect() == []
    two = lone.union(spark.createDataFrame([(5, 1, [1.0]), (6, 5, [0.5])], schema))
    assert [tuple(r) for r in negatives.mining_report(two).collect()] == [
        (100, 5, 1, 1, 32768, 16384), (100, 5, 2, 6, 32768, 16384)]


def test_slots_part_the_scores():
    uppers, scores = np.array([2, 5, 9]), np.arange(10)
    assert negatives.slots(scores, uppers).tolist() == [0, 0, 0, 1, 1, 1, 2, 2, 2, 2]


def test_scores_beyond_floating_point():
    big = np.full((1, 2), (1 << 30) + 1, np.int64)
    assert negatives._scores(big, big)[0, 0] == 2 * ((1 << 30) + 1) ** 2
    with pytest.raises(OverflowError):
        negatives._scores(big << 4, big << 4)


def test_mining_query_equals_sql(spark, sf):
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS FROM '{sf}/embeddings.parquet'")
    mine = QUERIES["op11_hard_negatives"](spark, sf)
    theirs = duckdb.sql(SQL["op11_hard_negatives"])
    assert mine.columns == theirs.columns
    assert sorted(map(tuple, mine.collect())) == sorted(theirs.fetchall()) != []


def held(found, rows, components):
    """Every promise of a whitening result, against numpy on the same rows."""
    kept = [(i, [math.floor(64 * x) + 1_000_000 for x in v]) for i, v in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = ((fit * n - sums) / n).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert sorted((r.vec_id, r.component) for r in found) == sorted((i, k) for i, _ in kept for k in range(1, components + 1))
    by = {}
    for r in found:
        by.setdefault((r.component, r.vec_id), []).append(r)
    sign = {}
    for i, x in kept:
        away = n * np.array(x, dtype=object) - sums
        for k in range(1, components + 1):
            want = float((away / n).astype(float) @ vectors[:, k - 1] / math.sqrt(values[k - 1]))
            rs = [r for r in by[k, i] if r.deviation == int((away**2).sum())]
            assert rs and all(r.n == n and math.isclose(r.explained, values[k - 1] / values.sum(), rel_tol=1e-9) for r in rs)
            sign.setdefault(k, 1 if rs[0].whitened * want >= 0 else -1)
            assert min(abs(r.whitened * sign[k] - want) for r in rs) < 1e-7
    errors = {r.identity_error for r in found}
    assert len(errors) == 1 and errors.pop() < 1e-9


def test_whitening_equals_numpy(spark, monkeypatch):
    monkeypatch.setattr(whitening, "LEAST_ROWS", 16)
    monkeypatch.setattr(whitening, "SPLITS", 3)
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 5) * [9, 5, 3, 2, 1]]) for i in range(100)]
    rows += [(200 + i, rows[3][1]) for i in range(60)] + [rows[3], (None, rows[4][1]), ((1 << 60) + 1, rows[5][1])]
    rows += [(300, None), (301, []), (302, [NAN] * 5), (303, [1.0, INF, 0.0, 0.0, 0.0]), (304, [None] * 5)]
    docs = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, n int, x int").repartition(4)
    found = whitening.whiten(docs, 4).collect()
    assert all(r.vec_id not in (300, 301, 302, 303, 304) for r in found)
    for r in found:
        if r.vec_id is None:
            assert r.deviation is not None
    held([r for r in found if r.vec_id is not None], [r for r in rows if r[0] is not None] , 4)


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whitening_report(spark.createDataFrame([], schema)).collect() == []
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0])], schema)
    assert {tuple(r) for r in whitening.whitening_report(same).collect()} == {
        (i, k, 1, 0, None, None, None) for i in (1, 2) for k in (1, 2)}
    flat = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], schema)
    found = {(r.vec_id, r.component): r for r in whitening.whitening_report(flat).collect()}
    assert abs(found[1, 1].whitened) == abs(found[2, 1].whitened) == 1 and found[1, 1].explained == 1
    assert found[1, 2].whitened is None and found[1, 2].explained == 0 and found[1, 1].identity_error < 1e-9


def test_whitening_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    held(QUERIES["op13_embedding_whitening"](spark, sf).collect(), rows, 16)


def test_indexed_rows_outlive_slow_calls(spark, monkeypatch):
    """The matrix behind the rows is still there when the call reaches the JVM late."""
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "index long, values array<double>")
    call = whitening.callMLlibFunc

    def late(*args):
        gc.collect()
        time.sleep(1)
        return call(*args)

    matrix = whitening.block_matrix(rows, 5, 2, 2)
    monkeypatch.setattr(whitening, "callMLlibFunc", late)
    got = {r["index"]: r["values"] for r in whitening.indexed_rows(matrix).collect()}
    assert got == {i: [float(i), 1.0] for i in range(5)}
