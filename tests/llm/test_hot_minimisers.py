"""Phrases that stand in very many surroundings are dealt to many buckets, and nothing is missed by that."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from steplens.llm import substring_dedup as S
from steplens.llm.common import words


def documents(rng, shared, n=240, size=90):
    """Texts of words that stand nowhere else around one shared passage."""
    texts = []
    for d in range(n):
        own = [f"w{d}x{i}" for i in range(size)]
        at = rng.randrange(1, size - 1)
        texts.append(" ".join(own[:at] + shared + own[at:]))
    return texts


def removed(texts, window):
    """Brute force: the number of words of each text that repeated windows cover."""
    found = Counter(tuple(t[i : i + window]) for t in map(str.split, texts) for i in range(len(t) - window + 1))
    out = []
    for t in map(str.split, texts):
        gone = {i + k for i in range(len(t) - window + 1) if found[tuple(t[i : i + window])] > 1 for k in range(window)}
        out.append(len(gone))
    return out


def test_no_bucket_holds_a_phrase_of_many_surroundings(spark):
    rng = random.Random(2)
    worst = 0
    for number in range(40):
        texts = documents(rng, [f"s{number}y{i}" for i in range(8)], 300, 120)
        table = spark.createDataFrame([(t,) for t in texts], "text string")
        given = sum(map(len, texts))
        deal = S.deal_of(table, bucket_bytes=given // 64) if number < 3 else None
        w = words(pa.array(texts))
        plain = S.Deal(S.WINDOW, S.MINIMISER, 3 * 64, np.empty(0, np.uint64), np.empty(0, np.uint64))
        deal = deal or S.Deal(S.WINDOW, S.MINIMISER, plain.buckets, np.arange(plain.buckets, dtype=np.uint64), np.empty(0, np.uint64))
        largest = {}
        for name, how in (("plain", plain), ("dealt", deal)):
            first, count, bucket = how.runs(w)
            begin, end = how.spans(w, first, count)
            sums = np.bincount(bucket.astype(int), end - begin)
            largest[name] = sums.max() / sums.sum()
        worst = max(worst, largest["plain"])
        assert largest["dealt"] < 0.03, (number, largest)  # four times an average of 1 in 192, and a margin
    assert worst > 0.1  # what a bucket would hold by the minimiser alone


@pytest.mark.parametrize("bucket_bytes", [3 << 20, 4000, 300])
def test_dealt_windows_against_brute_force(spark, bucket_bytes):
    rng = random.Random(4)
    texts = documents(rng, [f"a{i}" for i in range(8)]) + documents(rng, [f"b{i}" for i in range(30)]) + documents(rng, [f"c{i}" for i in range(45)], 60)
    texts += [" ".join(f"d{i % 3}" for i in range(200)), "", "one two", " ".join(f"e{i}" for i in range(40))] + [" ".join(f"e{i}" for i in range(40))] * 3
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    deal = S.deal_of(table, bucket_bytes=bucket_bytes)
    assert bool(len(deal.hot)) == (bucket_bytes < 1 << 20) and (bucket_bytes != 300 or len(deal.hotter))
    got = {r["doc_id"]: r["n_removed"] for r in S.remove_repeats(table, bucket_bytes=bucket_bytes).collect()}
    assert [got[i] for i in range(len(texts))] == removed(texts, S.WINDOW)


def test_equal_windows_share_a_bucket():
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(70)]
    texts = [" ".join([f"q{d}z{i}" for i in range(rng.randrange(50))] + passage + [f"r{d}z{i}" for i in range(rng.randrange(50))]) for d in range(12)]
    w = words(pa.array(texts))
    every = np.arange(64, dtype=np.uint64)
    for hotter in (np.empty(0, np.uint64), every[::3], every):
        first, count, bucket = S.Deal(35, 4, 64, every[::2], hotter).runs(w)
        at = defaultdict(set)
        seen = set()
        joined = w.joined.tobytes()
        for f, c, b in zip(first.tolist(), count.tolist(), bucket.tolist(), strict=True):
            for i in range(f, f + c):
                assert i not in seen
                seen.add(i)
                at[joined[w.start[i] : w.end[i + 34]]].add(b)
        assert len(seen) == sum(max(0, n - 34) for n in w.counts().tolist())
        assert all(len(b) == 1 for b in at.values())


@pytest.mark.parametrize("bucket_bytes", [3 << 20, 300])
def test_few_words_over_and_over_are_one_place(spark, bucket_bytes):
    """A text of one word pair had a place for every second window."""
    pair, phrase = ["p", "q"] * 150, [f"r{i}" for i in range(50)]
    own = [[f"w{d}x{i}" for i in range(40)] for d in range(6)]
    texts = [" ".join(o[:20] + pair + o[20:]) for o in own[:4]] + [" ".join(o[:30] + phrase * 5 + o[30:] + pair[:60]) for o in own[4:]] + ["q " + " ".join(pair)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r["_sl_id"]: r["_sl_spans"] for r in S.repeated_spans(table, bucket_bytes=bucket_bytes).collect()}
    assert set(spans) == set(range(7))
    assert max(len(spans[d]) for d in (0, 1, 2, 3, 6)) <= 8
    got = {r["doc_id"]: r["n_removed"] for r in S.remove_repeats(table, bucket_bytes=bucket_bytes).collect()}
    assert [got[d] for d in range(7)] == removed(texts, S.WINDOW)
