"""Held-out accuracy against the labels, and the parts of the model against plain versions."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tablewright.llm import quality as q

FOLDER = "/root/testdata/sf0.01"


def test_accuracy_on_labels(spark):
    """The labels take no part in training."""
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = q.op1_quality(spark, FOLDER).join(labels, "doc_id").collect()
    good, bad = [r.keep for r in rows if r.quality == 1], [r.keep for r in rows if r.quality == 0]
    assert np.mean(good) >= 0.99 and np.mean(bad) <= 0.1


def test_query_judges_every_document_and_reruns_agree(spark):
    first = {tuple(r) for r in q.op1_quality(spark, FOLDER).collect()}
    assert len(first) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert first == {tuple(r) for r in q.op1_quality(spark, FOLDER).collect()}


def plain_posteriors(votes, prior, right):
    out = []
    for row in votes:
        good, bad = prior, 1 - prior
        for j, v in enumerate(row):
            if v != q.ABSTAIN:
                good *= right[1, j] if v == q.GOOD else 1 - right[1, j]
                bad *= right[0, j] if v == q.BAD else 1 - right[0, j]
        out.append(good / (good + bad))
    return out


def test_label_model():
    rng = np.random.default_rng(3)
    truth = rng.random(20_000) < 0.85
    right = np.array([[0.45, 0.3, 0.4, 0.2], [0.97, 0.99, 0.95, 0.98]])
    hit = rng.random((len(truth), 4)) < right[truth.astype(int)]
    votes = np.where(hit, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.2] = q.ABSTAIN
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = q.fit_label_model(patterns, counts)
    assert abs(model.prior - 0.85) < 0.04 and np.abs(model.right - right).max() < 0.08
    assert np.allclose(model.posterior(patterns), plain_posteriors(patterns, model.prior, model.right))


@settings(max_examples=200, deadline=None)
@given(st.text("ab  B9!%\né", max_size=60))
def test_features(text):
    raw = text.encode()
    found = q.window_features(raw)
    words = raw.split()
    repeats = sum(a == b for a, b in zip(words, words[1:])) if len(raw) > 2 else 0
    assert (found == q._REPEAT).sum() == repeats
    assert len(found) - repeats == max(0, len(raw) - 2)
    places, shares = q.text_shares(text)
    scorer = q.Scorer(np.random.default_rng(1).normal(size=q.DIMENSIONS + 1), 0.3)
    if len(raw) > 2:
        want = 1 / (1 + np.exp(-np.clip(scorer.weights[places] @ shares + 0.3, -30, 30)))
        assert scorer.probability(text) == pytest.approx(want)


def test_edge_rows(spark):
    good = "The cat sat on the mat. It was a fine day, and nobody cared. " * 2
    rows = [(1, None, "a"), (None, "", "b"), (2, good, None), (2, good, None), (3, "word " * 300_000, "long"), (4, " \n\t ", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, p_good string")
    kept = q.keep_good(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert ids.count(2) == 2 and {1, None, 4} <= set(ids)
    assert q.keep_good(docs.where("false")).count() == 0
    silent = docs.where("doc_id = 4")
    assert q.keep_good(silent).count() == 1
    assert q.labeller_votes(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).count() == 6


def test_repeats_in_all_documents(spark):
    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("text").collect():
        words = r.text.encode().split()
        assert (q.window_features(r.text.encode()) == q._REPEAT).sum() == sum(a == b for a, b in zip(words, words[1:]))


@settings(max_examples=200, deadline=None)
@given(st.text("ab  \né", max_size=60), st.sampled_from([3, 5, 16]))
def test_pieces_lose_nothing(text, size):
    whole = q.window_features(text.encode())
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(q, "PIECE", size)
        parts = [q.window_features(*piece) for piece in q._pieces(text)]
    assert sorted(np.concatenate(parts).tolist()) == sorted(whole.tolist())


def test_scorer_against_a_dense_version(monkeypatch):
    monkeypatch.setattr(q, "DIMENSIONS", 5)
    rng = np.random.default_rng(4)
    x = rng.random((30, 6)) * (rng.random((30, 6)) < 0.5)
    good = rng.random(30)
    spread = x.std(axis=0)
    z, w, bias, seen, seen_bias = (x - x.mean(axis=0)) / (spread + 1e-4), np.zeros(6), 0.0, np.full(6, 1e-8), 1e-8
    for _ in range(300):
        error = 1 / (1 + np.exp(-(z @ w + bias))) - good
        slope = z.T @ error / 30 + 1e-3 * w
        seen, seen_bias = seen + slope**2, seen_bias + error.mean() ** 2
        w, bias = w - 0.1 * slope / np.sqrt(seen), bias - 0.1 * error.mean() / np.sqrt(seen_bias)
    scorer = q.fit_scorer([(np.flatnonzero(row), row[row != 0]) for row in x], good)
    assert np.allclose(x @ scorer.weights + scorer.bias, z @ w + bias, atol=1e-6)


def test_repeated_rows_are_drawn_once(spark):
    docs = spark.createDataFrame([(None, f"text {i} of many. " * 9) for i in range(50)] + [(7, "again and again. " * 9)] * 500, "doc_id long, text string")
    model, scorer = q.fit_quality_model(docs)
    _, same = q.fit_quality_model(docs.distinct())
    assert np.array_equal(scorer.weights.shape, same.weights.shape) and 0 < model.prior < 1
