"""Best-fit packing and nearest neighbours against plain versions."""

import random

import numpy as np
import pytest

from roadplan.llm import neighbours, packing


def plain_pack(pieces, lengths):
    """The same rules over a list of all bins."""
    bins, placed, left = [], [], sum(pieces)
    for p in pieces:
        fits = [b for b in range(len(bins)) if bins[b][0] - bins[b][1] >= p]
        if fits:
            room = min(bins[b][0] - bins[b][1] for b in fits)
            b = [b for b in fits if bins[b][0] - bins[b][1] == room]
            b = max(b, key=lambda x: bins[x][2])
        else:
            size = min((c for c in lengths if c >= p), key=lambda c: (packing.cost(c) / max(1, min(c, left)), c))
            bins.append([size, 0, 0])
            b = len(bins) - 1
        placed.append((b, bins[b][1]))
        bins[b][1] += p
        bins[b][2] = len(placed)
        left -= p
    final = [min((c for c in lengths if c >= used), key=packing.cost) for _, used, _ in bins]
    return [(b, o, final[b]) for b, o in placed]


@pytest.mark.parametrize("seed", range(5))
def test_pack_equals_plain_version(seed):
    rng = random.Random(seed)
    pieces = sorted((rng.randint(1, 64) for _ in range(300)), reverse=True)
    assert packing.pack(pieces, (16, 32, 64)) == plain_pack(pieces, (16, 32, 64))


def test_everything_is_packed_once(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 30, 64, 65, 700])), "x") for i in range(200)]
    rows += [(500, None, "y"), (501, " \n", "y"), (7, rows[7][1], "x"), (None, "a b\tc", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bin_id string")
    found = packing.packed_pieces(docs, lengths=(16, 64), shard_pieces=150).toPandas()
    bins = found.dropna(subset="bin_id").groupby("bin_id")
    assert (bins.n_tokens.sum() <= bins.bin_length.first()).all() and set(bins.bin_length.first()) <= {16, 64}
    for _, part in bins:
        part = part.sort_values("offset")
        assert (part.offset.to_numpy() == np.concatenate(([0], part.n_tokens.cumsum()[:-1]))).all()
    words = {}
    for i, text, _ in rows:
        words[i] = words.get(i, 0) + len((text or "").split())
    assert found.groupby("doc_id", dropna=False).n_tokens.sum().to_dict().__len__() == len(words)
    assert found.n_tokens.sum() == sum(words.values())
    assert found[found.n_tokens == 0].bin_id.isna().all() and len(found) == sum(
        max(1, -(-len((t or "").split()) // 64)) for _, t, _ in rows)
    assert packing.packed_pieces(docs.limit(0)).collect() == []
    assert packing.packed_sequences(docs, lengths=(64,)).count() > 0


def brute(rows, k):
    good = {}
    for i, v in rows:
        if i is not None and v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, dtype=np.float32).astype(float)
    out = {}
    for q in good:
        if q % 20 == 0:
            scored = sorted(((-float(good[q] @ v), i) for i, v in good.items() if i != q))[:k]
            out[q] = [(i, -s) for s, i in scored]
    return out


def made_vectors():
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(8).round(3).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[20][1]) for i in range(90)]  # one vector held by many
    rows += [(2000, None), (2001, [0.0] * 8), (2020, [1.0, None] + [0.0] * 6), (2040, [float("nan")] * 8), (None, [1.0] * 8),
             (2060, [float("inf")] + [0.0] * 7), (2080, [1.0] * 5), (40, rows[40][1])]
    return rows


def test_nearest_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "COVERED", 1.0)
    monkeypatch.setattr(neighbours, "TRIAL_QUERIES", 10_000)
    monkeypatch.setattr(neighbours, "CELL_ROWS", 60)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 40)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 5)
    rows = made_vectors()
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    found = {}
    for r in neighbours.nearest(frame, "vec_id % 20 = 0").orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(found[r.query_id])
    want = brute(rows, 20)
    assert found.keys() == want.keys()
    same = sum([i for i, _ in found[q]] == [i for i, _ in want[q]] for q in want)
    assert same >= len(want) - 1  # scores that differ in the last bit may swap
    assert all(abs(s - t) < 1e-12 for q in want for (_, s), (_, t) in zip(found[q], want[q], strict=True))


def test_few_and_no_vectors(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in neighbours.nearest(frame, "vec_id % 20 = 0").collect()] == [(0, 1, 2, 1.0), (0, 2, 1, 0.0)]
    assert neighbours.nearest(frame.limit(0), "vec_id % 20 = 0").collect() == []


def test_recall_of_the_query(spark, sf):
    from roadplan.llm.queries import QUERIES

    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    got = {}
    for r in QUERIES["op2_nearest_neighbours"](spark, sf).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for q in np.flatnonzero(ids % 20 == 0):
        scores = v @ v[q]
        scores[q] = -np.inf
        hits.append(len(got[ids[q]] & set(ids[np.lexsort((ids, -scores))[:20]])) / 20)
    assert np.mean(hits) >= 0.9
