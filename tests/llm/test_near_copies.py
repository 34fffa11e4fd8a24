"""Near copies of the pipeline: five words, similarity of 0.8 or more."""

import random

import numpy as np
import pyarrow as pa

from steplens.llm import near_copies


def changed(words, n, rng):
    """``words`` with ``n`` of them replaced, five apart at least."""
    out = list(words)
    for i in rng.sample(range(len(words) // 5), n):
        out[5 * i + 2] = f"n{rng.randrange(10**9)}"
    return out


def shingle_set(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_bands_find_the_similar():
    rng = random.Random(3)
    for changes, least in ((4, 0.99), (3, 0.995), (2, 0.999)):  # similarity of about 0.8, 0.85 and 0.9
        texts, n = [], 400
        for _ in range(n):
            w = [f"w{rng.randrange(50000)}" for _ in range(184)]
            texts += [" ".join(w), " ".join(changed(w, changes, rng))]
        keys = near_copies.band_keys(*near_copies.shingles(pa.array(texts)))
        mean = np.mean([jaccard(shingle_set(texts[2 * i]), shingle_set(texts[2 * i + 1])) for i in range(n)])
        recall = (keys[::2] == keys[1::2]).any(axis=1).mean()
        print("similarity", round(mean, 3), "recall", recall)
        assert recall >= least


def test_similar_pairs_are_joined_and_others_are_not(spark):
    rng = random.Random(4)
    texts = []
    for changes in (1, 2, 3, 4, 4, 4, 6, 8):
        w = [f"w{rng.randrange(50000)}" for _ in range(184)]
        texts += [" ".join(w), " ".join(changed(w, changes, rng)).upper()]
    w = [f"v{rng.randrange(50000)}" for _ in range(184)]
    texts += [" ".join(changed(w, rng.choice((0, 1, 2, 5)), rng)) for _ in range(24)]  # a full band, of pairs on both sides of 0.8
    texts += ["a b", "a  B", "a c", None, "", "\n"]
    sets = [shingle_set(t or "") for t in texts]
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or sets[i] and sets[j] and jaccard(sets[i], sets[j]) >= 0.8:
                a, b = want[i], want[j]
                want = [min(a, b) if x in (a, b) else x for x in want]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for part in (near_copies.PART, 3):
        got = {r["doc_id"]: r["component_id"] for r in near_copies.near_duplicates(docs, part).collect()}
        assert [got[i] for i in range(len(texts))] == want
    assert sorted(r["doc_id"] for r in near_copies.keep_one(docs).select("doc_id").collect()) == sorted(set(want))
    assert near_copies.keep_one(docs.limit(0)).collect() == []


def test_pipeline_stage_takes_five_words_and_similarity(spark, sf_dir):
    import corpus_pipeline

    rng = random.Random(5)
    texts = []
    for _ in range(20):
        w = [f"w{rng.randrange(50000)}" for _ in range(184)]
        texts += [" ".join(w), " ".join(changed(w, 3, rng))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = corpus_pipeline.near_stage(spark, docs, sf_dir).select("doc_id").collect()
    assert sorted(r[0] for r in kept) == list(range(0, 40, 2))
