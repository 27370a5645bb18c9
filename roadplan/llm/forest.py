"""N-gram Jaccard join with MinHash banding, the fixed-depth form of an LSH forest.

1. Each text becomes its set of five-word shingles and, per tree, one hash of ``depth`` min-hashes. Texts with the same
   set are one entry from here on.
2. ``depth`` is fixed before any data is read: the longest prefix, of at most ``MAX_DEPTH``, at which pairs at the threshold
   meet in some tree with the target recall. Entries that share a tree's hash, a node at this depth, are linked to the least of
   them (a star, never all pairs), and components of these links are formed. There are no sorted tries and no prefixes
   per entry: these serve a search for the nearest few, whereas a join at one threshold needs the same depth for all.
3. Components are cut into blocks of bounded size, block pairs are compared exactly inside tasks, and only counts and a
   spanning forest of the verified links leave a task. A third of all texts may be near copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadplan.llm.components import components
from roadplan.llm.words import SHINGLE, batches, shingle_sets
from roadplan.operators.spatial import checkpointed

THRESHOLD = 0.8
RECALL = 0.999
TREES, MAX_DEPTH = 16, 8
#: Up to so many candidates (about 40 bytes each) are sent to all tasks instead of shuffling every text.
BROADCAST_ROWS = 1_000_000
#: Entries and shingles in a block; a component of more is cut up, smaller ones share tasks.
BLOCK_ENTRIES, BLOCK_SHINGLES = 512, 400_000


def forest_depth(threshold: float, recall: float, trees: int, max_depth: int) -> int:
    """The longest prefix at which pairs of similarity ``threshold`` share a node of some tree often enough."""
    depth = max_depth
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def _sketches(parts: Iterator[pd.DataFrame], trees: int, depth: int, size: int) -> Iterator[pd.DataFrame]:
    random = np.random.default_rng(20240817)
    factors = random.integers(1, 1 << 63, (trees, depth), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for part in parts:
        texts = [t or "" for t in part["text"]]
        for i, j in batches(texts):
            sets, first = shingle_sets(texts[i:j], size)
            full = np.flatnonzero(np.diff(first))
            paths = np.zeros((j - i, trees), np.uint64)
            for t in range(trees) if len(full) else ():
                paths[full, t] = t + 1
                for d in range(depth):
                    least = np.minimum.reduceat((sets * factors[t, d]) >> np.uint64(24), first[full])
                    paths[full, t] = paths[full, t] * np.uint64(0x9E3779B97F4A7C15) + least
            # the set's own 128 bits: two sums over its members
            keys = np.zeros((j - i, 2), np.uint64)
            if len(full):
                keys[full, 0] = np.add.reduceat(sets, first[full])
                keys[full, 1] = np.add.reduceat(sets * (sets >> np.uint64(7) | np.uint64(1)), first[full])
            yield pd.DataFrame({
                "id": part["id"].values[i:j], "k1": keys[:, 0].view(np.int64), "k2": keys[:, 1].view(np.int64),
                "size": np.diff(first), "paths": list(paths.view(np.int64)),
            })


def _links(entries: list[tuple], first_block: int, second_block: int, threshold: float) -> Iterator[tuple]:
    """(entry, links, least entry linked to it here); each entry is (rep, weight, block, sorted shingles)."""
    n = len(entries)
    sizes = np.array([len(e[3]) for e in entries])
    _, codes = np.unique(np.concatenate([e[3] for e in entries]), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    weight = np.array([e[1] for e in entries])
    block = np.array([e[2] for e in entries])
    links, root = np.zeros(n, np.int64), list(range(n))
    marks = np.zeros(codes.max() + 1, np.int32)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in np.flatnonzero(block == first_block):
        own = codes[starts[i]: starts[i + 1]]
        marks[own] = 1
        if first_block == second_block:
            others = np.arange(i + 1, n)
        else:
            others = np.flatnonzero(block == second_block)
        if len(others):
            lo, hi = others[0], others[-1] + 1  # sorted by block
            shared = np.add.reduceat(marks[codes[starts[lo]: starts[hi]]], starts[lo:hi] - starts[lo])
            near = others[shared >= threshold * (sizes[i] + sizes[others] - shared)]
            links[i] += weight[near].sum()
            links[near] += weight[i]
            for j in near:
                a, b = find(i), find(j)
                if a != b:
                    root[max(a, b)] = min(a, b)
        marks[own] = 0
    for i in range(n):
        yield entries[i][0], links[i], entries[find(i)][0]


def _compare(part: pd.DataFrame, threshold: float) -> pd.DataFrame:
    rows = []
    for (_, i, j), group in part.groupby(["root", "i", "j"], sort=False):
        group = group.sort_values(["block", "rep"])
        entries = [
            (r, w, b, np.frombuffer(s, np.int64))
            for r, w, b, s in zip(group["rep"], group["weight"], group["block"], group["shingles"], strict=True)
        ]
        rows += _links(entries, i, j, threshold)
    return pd.DataFrame(rows, columns=["rep", "links", "near"])


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES,
    shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id_col, class_id, n_links) for every distinct id and text.

    Two documents are linked if the Jaccard similarity of their shingle sets is ``threshold`` or more; copies count.
    ``class_id`` is the least id connected by links, ``n_links`` the number of other documents linked to this one.
    Texts without a word (null, empty, blank) are linked to nothing, each is its own class. Rows that repeat id and
    shingle set are one document; different texts under one id fall into one class. A null id takes no part and comes
    back with null class and 0 links. Other columns of ``docs`` aren't read. An empty table gives an empty table.
    """
    depth = forest_depth(threshold, recall, trees, MAX_DEPTH)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    nameless = rows.where("id is null").select("text").distinct()
    # a null among ids would turn them to floating point on their way to Python
    sketches = checkpointed(rows.where("id is not null").mapInPandas(
        lambda parts: _sketches(parts, trees, depth, shingle),
        "id long, k1 long, k2 long, size long, paths array<long>",
    ))
    members = sketches.select("id", "k1", "k2", "size").distinct()
    entries = members.where("size > 0").groupBy("k1", "k2", "size").agg(F.min("id").alias("rep"), F.count("*").alias("weight"))
    entries = checkpointed(entries)
    own = sketches.where("size > 0").withColumnRenamed("id", "rep").join(entries, ["rep", "k1", "k2", "size"])
    nodes = own.dropDuplicates(["rep", "k1", "k2", "size"]).select("rep", F.explode("paths").alias("node"))
    stars = nodes.groupBy("node").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub < last")
    found = nodes.join(stars, "node").where("rep > hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    candidates = checkpointed(
        components(found).withColumnRenamed("node", "rep").join(entries, "rep").select("rep", "root", "weight", "size"))
    classes, links = _verified(docs, candidates, threshold, shingle, id_col, text_col)
    ids = members.join(entries, ["k1", "k2", "size"], "left")
    ids = ids.join(classes, "rep", "left").join(links, "rep", "left")
    found = ids.select(
        F.col("id").alias(id_col), F.coalesce("root", "rep", "id").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("weight") - 1, F.lit(0))).alias("n_links"))
    none = F.lit(None).cast("long")
    return found.unionByName(nameless.select(none.alias(id_col), none.alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def _verified(docs: DataFrame, candidates: DataFrame, threshold: float, shingle: int, id_col: str, text_col: str):
    """Classes (rep, root) and links (rep, links) after the exact comparison."""
    blocks = F.ceil(F.greatest(
        F.col("entries") / BLOCK_ENTRIES, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    sizes = candidates.groupBy("root").agg(F.count("*").alias("entries"), F.sum("size").alias("shingles"))
    placed = candidates.join(sizes.withColumn("blocks", blocks), "root").select(
        "rep", "root", "weight", "size", "blocks", F.expr("pmod(hash(rep), blocks)").alias("block"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(
        F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    rows = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text")).where("rep is not null")

    def with_sets(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = [t or "" for t in part["text"]]
            for i, j in batches(texts):
                sets, first = shingle_sets(texts[i:j], shingle)
                out = part.iloc[i:j].drop(columns="text")
                yield out.assign(shingles=[sets[a:b].tobytes() for a, b in zip(first, first[1:], strict=False)])

    entry = "rep long, root long, weight long, blocks int, block int"
    total, count = candidates.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    placed = placed.drop("size") if count > BROADCAST_ROWS else F.broadcast(placed.drop("size"))
    sets = rows.join(placed, "rep").select("text", "rep", "root", "weight", "blocks", "block")
    sets = sets.mapInPandas(with_sets, entry + ", shingles binary").dropDuplicates(["rep", "shingles"])
    dealt = sets.select("rep", "root", "weight", "block", "shingles", F.explode(pairs).alias("p")).select(
        "rep", "root", "weight", "block", "shingles", "p.i", "p.j")
    tasks = max(1, int(total // BLOCK_SHINGLES))
    dealt = dealt.withColumn("task", F.pmod(F.xxhash64("root", "i", "j"), F.lit(tasks)))
    compared = checkpointed(dealt.groupBy("task").applyInPandas(
        lambda part: _compare(part, threshold), "rep long, links long, near long"))
    links = compared.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(compared.where("rep <> near").select(F.col("rep").alias("a"), F.col("near").alias("b")))
    return joined.withColumnRenamed("node", "rep"), links


def class_report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs.select("doc_id", "text"))


def keep_one_of_each_class(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents whose near-duplicate class has a document of a lesser id.

    Repeated rows of one id that stay all stay; a null id stays.
    """
    gone = near_duplicates(docs).where("doc_id <> class_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
