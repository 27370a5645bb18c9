"""The stages over a small table."""

import corpus_pipeline
from roadplan.llm import decontaminate, forest, packing


def test_stages_keep_their_promises(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], sf).cache())
    assert all(k.columns == docs.columns for k in kept[1:-1])
    counts = [k.count() for k in kept]
    assert counts[0] >= counts[1] == counts[2] >= counts[3] >= counts[4] > 0 and counts[1] > 0.7 * counts[0]
    classes = forest.near_duplicates(kept[3])
    assert classes.where("n_links > 0").count() == 0
    assert decontaminate.overlaps(kept[4], bench).count() == 0
    packed = {p.doc_id for r in kept[5].collect() for p in r.pieces}
    words = packing.packed_pieces(kept[4]).where("n_tokens > 0").select("doc_id").distinct().count()
    assert len(packed) == words


def test_run_and_extra_columns(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
    docs = spark.createDataFrame(
        [(1, None, "x", 1), (None, "", "y", 2), (3, "a b", None, 3)], "doc_id long, text string, score string, n_lines int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "score", "n_lines"]


def test_line_dedup_keeps_the_values_of_clashing_columns(spark, sf):
    rows = [(i, f"head\nown {i}", f"n{i}", "d", "k") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines string, n_dropped string, _lines string")
    found = corpus_pipeline.dedup_lines(spark, docs, sf)
    assert found.columns == docs.columns
    assert sorted(map(tuple, found.collect())) == sorted((i, f"own {i}", n, d, k) for i, _, n, d, k in rows)
