"""Approximate nearest neighbours by largest inner product, with randomly rotated one-bit codes.

Vectors fall into cells around centres. A vector's difference to its centre is turned by a random rotation and kept as
one bit per dimension, with its length and the code's agreement with it as correction scalars. For a query these give an
estimate of the inner product and a bound of its error; only vectors whose upper bound reaches what the query already has
are compared in double precision.

Equal vectors are one entry, which keeps the ids that can still be among the first ``k``. Centres and the number of cells
that a query visits are fitted on bounded samples (``FIT_ROWS`` vectors, ``TRIAL_QUERIES`` queries against all vectors); every
vector is indexed. Cells and the queries of a cell are cut into blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadplan.operators.spatial import checkpointed

FIT_ROWS, TRIAL_QUERIES = 20_000, 100
CELL_ROWS, MAX_CELLS = 256, 4096
BLOCK_ROWS, BLOCK_QUERIES = 4096, 4096
#: Cells visited in the first round, and how many times as many after each further round.
FIRST_CELLS, MORE_CELLS = 2, 7
#: Share of the trial queries' true neighbours that lie in visited cells.
COVERED = 0.985
#: Width of the error bound in standard errors of the estimate.
WIDTH = 3.0


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) with finite components, not all zero, of the commonest length (the shortest of equally common ones)."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where("vec_id is not null").where(F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False)))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (lengths.n if lengths else 0))


class Index:
    """Centres, the rotation, and per centre how far its vectors are spread; small enough to be sent to every task."""

    def __init__(self, centres: np.ndarray, spread: np.ndarray):
        dim = centres.shape[1]
        self.centres, self.spread = centres, spread
        self.rotation = np.linalg.qr(np.random.default_rng(11).standard_normal((dim, dim)))[0]

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        return (vectors @ self.centres.T * 2 - (self.centres**2).sum(axis=1)).argmax(axis=1)

    def ranked_cells(self, queries: np.ndarray) -> np.ndarray:
        """Cells by how large an inner product is to be expected in them."""
        reach = queries @ self.centres.T + np.linalg.norm(queries, axis=1)[:, None] * self.spread * 2 / np.sqrt(queries.shape[1])
        return np.argsort(-reach, axis=1, kind="stable")

    def encode(self, vectors: np.ndarray, cells: np.ndarray):
        """Packed bits, length of the difference and agreement of code and difference."""
        rest = vectors - self.centres[cells]
        length = np.linalg.norm(rest, axis=1)
        turned = rest / np.maximum(length, 1e-300)[:, None] @ self.rotation
        agreement = np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])
        return np.packbits(turned > 0, axis=1), length, agreement


def fit_index(sample: np.ndarray, total: int, rounds: int = 8) -> Index:
    random = np.random.default_rng(5)
    cells = int(min(MAX_CELLS, max(1, total // CELL_ROWS), len(sample)))
    centres = sample[np.sort(random.choice(len(sample), cells, replace=False))].copy()
    for _ in range(rounds):
        near = (sample @ centres.T * 2 - (centres**2).sum(axis=1)).argmax(axis=1)
        counts = np.bincount(near, minlength=cells)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    gaps = np.linalg.norm(sample - centres[near], axis=1)
    spread = np.bincount(near, gaps, cells) / np.maximum(np.bincount(near, minlength=cells), 1)
    return Index(centres, np.maximum(spread, gaps.mean() * 0.5))


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(len(column), dim)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, ties to the smaller id."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= edge)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _search(queries: pd.DataFrame, block: pd.DataFrame, index: Index, k: int) -> Iterator[tuple]:
    dim = index.centres.shape[1]
    cell = int(block["cell"].iloc[0])
    vectors, reps = _matrix(block["v"], dim), block["rep"].to_numpy()
    bits = np.unpackbits(np.frombuffer(b"".join(block["code"]), np.uint8).reshape(len(block), -1), axis=1, count=dim)
    signs = (bits.astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dim))
    length, agreement = block["length"].to_numpy(), np.maximum(block["agreement"].to_numpy(), 1e-9)
    error = length * np.sqrt(np.maximum(1 - agreement**2, 0)) / agreement * WIDTH / np.sqrt(max(dim - 1, 1)) + 1e-6
    scale = length / agreement
    centre = index.centres[cell]
    for start in range(0, len(queries), 256):
        part = queries.iloc[start: start + 256]
        q = _matrix(part["q"], dim)
        turned = (q @ index.rotation).astype(np.float32)
        estimate = (q @ centre)[:, None] + (turned @ signs.T) * scale
        bound = np.linalg.norm(q, axis=1)[:, None] * error
        floor = part["floor"].to_numpy()
        if len(reps) > k:
            lower = estimate - bound
            floor = np.maximum(floor, np.partition(lower, len(reps) - k, axis=1)[:, len(reps) - k])
        upper = estimate + bound
        for i, qid in enumerate(part["qid"]):
            at = np.flatnonzero(upper[i] >= floor[i])
            scores = vectors[at] @ q[i]
            at = at[scores >= part["floor"].iloc[i]]
            scores = scores[scores >= part["floor"].iloc[i]]
            for j in _best(scores, reps[at], k):
                yield int(qid), int(reps[at[j]]), float(scores[j])


def _visits(queries: DataFrame, shared, first: int, last: int) -> DataFrame:
    """(qid, q, floor, cell) for the cells number ``first`` to ``last`` on each query's list."""
    def rank(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        for part in parts:
            for start in range(0, len(part), 512):
                rows = part.iloc[start: start + 512]
                ranked = index.ranked_cells(_matrix(rows["q"], index.centres.shape[1]))[:, first:last]
                yield rows.assign(cells=list(ranked.astype(np.int32)))

    found = queries.select("qid", "q", "floor").mapInPandas(rank, "qid long, q array<double>, floor double, cells array<int>")
    return found.select("qid", "q", "floor", F.explode("cells").alias("cell"))


def _visit(visits: DataFrame, entries: DataFrame, counts: dict[int, int], shared, k: int) -> DataFrame:
    """(qid, rep, score): per query and block the k best entries that reach the query's floor."""
    spark = entries.sparkSession
    asked = dict(visits.groupBy("cell").count().collect())
    plan = spark.createDataFrame(
        [(int(c), -(-n // BLOCK_ROWS), -(-asked.get(c, 0) // BLOCK_QUERIES)) for c, n in counts.items() if asked.get(c)],
        "cell int, blocks int, lots int")
    deal = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = visits.join(F.broadcast(plan), "cell").select(
        "cell", F.pmod(F.xxhash64("qid"), F.col("lots")).cast("int").alias("lot"), "qid", "q", "floor", deal("blocks").alias("block"))
    right = entries.join(F.broadcast(plan), "cell").select(
        "cell", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"), "rep", "v", "code", "length",
        "agreement", deal("lots").alias("lot"))

    def search(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        rows = list(_search(queries, block, shared.value, k)) if len(queries) and len(block) else []
        return pd.DataFrame(rows, columns=["qid", "rep", "score"])

    key = ["cell", "block", "lot"]
    return left.groupBy(key).cogroup(right.groupBy(key)).applyInPandas(search, "qid long, rep long, score double")


def _first(rows: DataFrame, key: str, order: list, k: int, name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(name) <= k)


def nearest(
    vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where the condition ``is_query`` on ``vec_id`` holds.

    Each query gets the k found with the largest inner product of the original vectors in double precision, itself
    excluded, ties to the smaller vec_id; all candidates if there are fewer. Vectors that are null, zero, with null or
    non-finite components, with a null id or not of the commonest length take no part. Repeated ids with equal
    vectors count once; with different vectors, each vector is a candidate and the first found counts. Other columns
    aren't read. An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    rows = checkpointed(valid_vectors(vectors, id_col, vector_col).distinct())
    # one entry per vector; no more than its k + 1 least ids can be among the first k of any query
    members = checkpointed(_first(rows, "v", ["vec_id"], k + 1, "place"))
    entries = members.where("place = 1").select(F.col("vec_id").alias("rep"), "v")
    total = entries.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not total:
        return empty
    share = min(1.0, FIT_ROWS / total)
    sample = entries.where(F.pmod(F.xxhash64("rep"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("v").collect()
    sample = sample or entries.select("v").limit(1).collect()
    index = fit_index(np.array([r.v for r in sample]), total)
    shared = spark.sparkContext.broadcast(index)

    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for part in parts:
            v = _matrix(part["v"], own.centres.shape[1])
            for start in range(0, len(v), 1024):
                some = v[start: start + 1024]
                cells = own.cells(some)
                bits, length, agreement = own.encode(some, cells)
                yield part.iloc[start: start + 1024].assign(
                    cell=cells.astype(np.int32), code=[b.tobytes() for b in bits], length=length, agreement=agreement)

    indexed = checkpointed(entries.mapInPandas(
        encode, "rep long, v array<double>, cell int, code binary, length double, agreement double"))
    counts = dict(indexed.groupBy("cell").count().collect())

    asking = rows.where(is_query).select("vec_id", "v")
    one_each = checkpointed(asking.groupBy("v").agg(F.min("vec_id").alias("qid")).select("qid", F.col("v").alias("q")))
    visited = _cells_to_visit(one_each, indexed, index, shared, k)
    # each round visits several times the cells before it and raises the floors, so few rows leave the tasks of the next
    asked = one_each.withColumn("floor", F.lit(float("-inf")))
    found, first, last = None, 0, min(FIRST_CELLS, visited)
    while first < last:
        reached = _visit(_visits(asked, shared, first, last), indexed, counts, shared, k + 1)
        best = _first(reached if found is None else found.union(reached), "qid", [F.desc("score"), "rep"], k + 1)
        found = checkpointed(best.select("qid", "rep", "score"))
        first, last = last, min(visited, last * MORE_CELLS)
        if first < last:
            floors = found.groupBy("qid").agg(F.min("score").alias("least"), F.count("*").alias("n"))
            floor = F.when(F.col("n") > k, F.col("least")).otherwise(float("-inf"))
            asked = checkpointed(one_each.join(floors, "qid", "left").select(
                "qid", "q", F.coalesce(floor, F.lit(float("-inf"))).alias("floor")))

    same = members.where("place = 1").select(F.col("vec_id").alias("rep"), "v").join(
        members.select("vec_id", "v"), "v").select("rep", "vec_id")
    listed = _first(found.join(same, "rep"), "qid", [F.desc("score"), "vec_id"], k + 1).select("qid", "vec_id", "score")
    query_ids = asking.join(one_each.withColumnRenamed("q", "v"), "v").select(F.col("vec_id").alias("query_id"), "qid")
    results = query_ids.join(listed, "qid").where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(
        F.max("score").alias("score"))
    return _first(results, "query_id", [F.desc("score"), "vec_id"], k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _cells_to_visit(queries: DataFrame, indexed: DataFrame, index: Index, shared, k: int) -> int:
    """How far down its list a query must go to cover the wanted share of true neighbours, from trial queries."""
    n = queries.count()
    share = min(1.0, TRIAL_QUERIES / max(1, n))
    trial = queries.where(F.pmod(F.xxhash64("qid"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("q").collect()
    if not trial:
        return len(index.centres)
    asked = np.array([r.q for r in trial])
    trials = indexed.sparkSession.sparkContext.broadcast(asked)

    def exact(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            scores = trials.value @ _matrix(part["v"], asked.shape[1]).T
            reps, cells = part["rep"].to_numpy(), part["cell"].to_numpy()
            rows = [(i, cells[j], reps[j], s[j]) for i, s in enumerate(scores) for j in _best(s, reps, k + 1)]
            yield pd.DataFrame(rows, columns=["qid", "cell", "rep", "score"])

    true = _first(indexed.select("rep", "v", "cell").mapInPandas(
        exact, "qid long, cell int, rep long, score double"), "qid", [F.desc("score"), "rep"], k + 1).collect()
    place = np.argsort(index.ranked_cells(asked), axis=1)
    needed = np.array([place[r.qid, r.cell] for r in true])
    return int(np.quantile(needed, COVERED, method="higher")) + 1
