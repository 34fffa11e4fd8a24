"""Repeated rows of a vec_id count once in the search."""

import numpy as np

from steplens.llm import ann


def test_repeated_rows_against_brute_force(spark):
    x = np.random.default_rng(6).normal(size=(300, 8)).astype("float32")
    x[7] *= 3  # scores well, and stands 5,000 times
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows + rows + [rows[7]] * 5000, "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([rows[i] for i in range(0, 300, 15)] * 2, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(vectors, queries, recall=1).collect():  # every leaf, so that nothing else is missed
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    for i in range(0, 300, 15):
        s = x.astype(float) @ x[i].astype(float)
        s[i] = -np.inf
        assert len(got[i]) == 20 and len(set(got[i]) & set(np.argsort(-s)[:20].tolist())) == 20


def test_repeated_rows_by_the_search_as_it_stands(spark):
    x = np.random.default_rng(16).normal(size=(1500, 16)).astype("float32")
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows * 2 + [rows[7]] * 3000, "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([rows[i] for i in range(0, 1500, 20)] * 2, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(vectors, queries).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = 0
    for i in range(0, 1500, 20):
        s = x.astype(float) @ x[i].astype(float)
        s[i] = -np.inf
        assert len(got[i]) == len(set(got[i])) == 20
        hits += len(set(got[i]) & set(np.argsort(-s)[:20].tolist()))
    assert hits / (20 * 75) >= 0.92
