"""The ranker against a plain reading of its loss, and its features."""

import numpy as np
import pyarrow as pa

from steplens.llm import quality


def test_the_weights_are_at_the_least_loss():
    rng = np.random.default_rng(4)
    z = rng.normal(size=(60, 7)).astype(np.float32)
    label = (z[:, 0] + rng.normal(size=60) > 0).astype(int)
    pairs, ridge = 3, 1e-2
    w = quality._prefer(z, label, pairs, ridge)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    least, draw = min(len(good), len(bad)) * pairs, np.random.default_rng(7)
    better, worse = (np.resize(s, least) if len(s) * pairs <= least else draw.choice(s, least) for s in (good, bad))

    def loss(w):
        d = (z[better] - z[worse]).astype(float)
        return np.log1p(np.exp(-d @ w)).mean() + ridge / 2 * w @ w

    assert all(loss(w) < loss(w + 0.02 * e) and loss(w) < loss(w - 0.02 * e) for e in np.eye(7))


def test_features_of_whole_texts():
    texts = ["", None, "ab", "abc", "Aa aA " * 3000 + "end", "é ü", "x y z"]
    x = quality.features(pa.array(texts, pa.string()))
    assert x.shape == (7, quality.COLUMNS) and np.isfinite(x).all() and (x[:2, len(quality.SHAPE) :] == 0).all()
    words = x[:, len(quality.SHAPE) : len(quality.SHAPE) + quality.WORD_COLUMNS]
    assert np.allclose((words[2:] ** 2).sum(axis=1), 1)
    one = [quality.features(pa.array([t], pa.string()))[0] for t in texts]
    assert np.array_equal(x, np.array(one))  # a text's features do not depend on its neighbours
    assert sorted(np.unique(np.round(words[4][words[4] > 0] ** 2, 6)).tolist()) == sorted({round(6000 / 6001, 6), round(1 / 6001, 6)})


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a text"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in quality.score_documents(docs, labels).collect()] == [0.5, 0.5]
    only = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert [r["score"] for r in quality.score_documents(docs, only).collect()] == [0.5, 0.5]
