"""Quality and language: held-out accuracy, odd rows, and the field's probabilities against enumeration."""

import itertools

import numpy as np
import pytest

from roadplan.llm import language, quality
from roadplan.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"


def test_quality_on_held_out_documents(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op5_quality_classifier"](spark, DATA).collect() if r.held_out and r.doc_id in labels]
    good = [r.score for r in rows if labels[r.doc_id] == 1]
    bad = [r.score for r in rows if labels[r.doc_id] == 0]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95
    assert np.mean([s >= 0.7 for s in good]) > 0.97
    assert all(r.predicted == (r.score >= 0.7) for r in rows)


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 9.0), (2, "", 9.0), (None, "a b", 9.0), (2, "\n", 9.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    found = quality.quality_report(docs, labels).collect()
    assert len(found) == 4 and all(0 <= r.score <= 1 for r in found)
    assert quality.quality_report(docs.limit(0), labels).collect() == []
    assert len({r.score for r in quality.quality_report(docs, labels.limit(0)).collect()}) == 1
    assert quality.accepted(docs, labels).columns == docs.columns


def test_risk_never_rewards_denying_unlabelled_positives():
    texts = ["good words here"] * 30
    w = quality.fit_nnpu(quality.Rows(texts), quality.Rows(texts), 0.9, rounds=60)
    assert quality.margins(["good words here"], w)[0] > 0


def test_language_on_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = [r for r in QUERIES["op9_language_id"](spark, DATA).collect() if r.held_out]
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in rows]) > 0.97


def test_language_of_odd_rows(spark):
    rows = [(1, None, "en"), (2, " 12 !\n", "fr"), (3, "the of and", "en"), (None, "le la", "fr"), (4, "le la les", "fr"), (5, "x", None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, lang_pred int")
    found = {r.doc_id: r for r in language.language_report(docs).collect()}
    assert found[1].lang_pred == found[2].lang_pred == "und" and found[1].score == 0
    assert found[3].lang_pred in ("en", "fr") and len(found) == 6
    assert language.language_report(docs.limit(0)).collect() == []
    assert {r.lang_pred for r in language.language_report(docs.where("lang is null")).collect()} == {"und"}


def test_code_switched_words(spark):
    texts = ["the house of the men is there", "la maison de les hommes est ici"] * 40
    model = language.fit_crf(texts, np.array([0, 1] * 40), ["en", "fr"])
    words = language.Words(["the men there la maison ici"])
    assert model.word_probabilities(words).argmax(axis=1).tolist() == [0, 0, 0, 1, 1, 1]


@pytest.mark.parametrize("lengths", [[3], [1, 4, 2, 4], [5, 1]])
def test_forward_backward_equals_enumeration(lengths):
    rng = np.random.default_rng(1)
    n, k = sum(lengths), 3
    evidence, transitions = rng.standard_normal((n, k)), rng.standard_normal((k, k))
    heads = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    chains = language.Chains(heads, np.array(lengths))
    p, expected = chains.forward_backward(evidence.astype(np.float32), transitions, True)
    got = np.empty((n, k))
    got[chains.place] = p
    want, pairs = np.zeros((n, k)), np.zeros((k, k))
    for head, length in zip(heads, lengths, strict=True):
        total, own, own_pairs = 0.0, np.zeros((length, k)), np.zeros((k, k))
        for path in itertools.product(range(k), repeat=length):
            s = np.exp(sum(evidence[head + t, y] for t, y in enumerate(path)) + sum(transitions[a, b] for a, b in zip(path, path[1:])))
            total += s
            for t, y in enumerate(path):
                own[t, y] += s
            for a, b in zip(path, path[1:]):
                own_pairs[a, b] += s
        want[head: head + length] = own / total
        pairs += own_pairs / total
    assert np.allclose(got, want, atol=1e-6) and np.allclose(expected, pairs, atol=1e-6)
