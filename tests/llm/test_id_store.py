"""The store of ids: bounded by bytes, with long words let go after their batch."""

import random
import resource
import sys

import numpy as np
import public_tokenizers
import pytest

from steplens.llm.sentencepiece_codec import Codec
from steplens.llm.tokens import LONGEST, MOST_BYTES, IdStore, end_to_end


def held(store):
    return sum(map(sys.getsizeof, store.index)) + store.flat.nbytes + store.start.nbytes + store.size.nbytes + sys.getsizeof(store.index)


def test_many_texts_without_spaces():
    """50,000 texts of 3,000 characters that are never the same leave a worker well under 500 MB."""
    store = IdStore(lambda new: end_to_end(np.arange(len(x), dtype=np.int32) for x in new))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for batch in range(500):
        texts = [f"{batch}-{i}-" + "字" * 3000 for i in range(100)]
        entries = store.lookup(texts)
        ids, offsets = store.gather(entries, np.arange(101))
        assert len(ids) == sum(map(len, texts)) and offsets[-1] == len(ids)
    assert held(store) < 4 * MOST_BYTES and (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 500


def test_many_short_words_stay_within_bounds():
    store = IdStore(lambda new: end_to_end(np.array([len(x)], np.int32) for x in new), most_bytes=1 << 20)
    for batch in range(40):
        words = [f"{batch}w{i}" for i in range(3000)]
        entries = store.lookup(words)
        assert store.gather(entries, np.arange(3001))[0].tolist() == list(map(len, words))
        assert store.bytes < 3 << 20 and held(store) < 6 << 20


@pytest.mark.parametrize("most", [1 << 10, 1 << 16, 1 << 26])
def test_the_same_ids_whatever_is_kept(most):
    rng = random.Random(most)
    codec = Codec(public_tokenizers.path("piece_bpe_32k.model"))
    codec.store.most_bytes = most
    words = ["a", "the", "of", "日本語" * LONGEST, "x" * (LONGEST + 1), "é", "word"]
    for _ in range(30):
        texts = [" ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(rng.randrange(30))) for _ in range(5)]
        ids, ends = codec.encode(texts)
        for i, t in enumerate(texts):
            assert codec.decode(ids[ends[i] : ends[i + 1]].tolist()) == t
