"""Fingerprints against a plain reading of the contract, and the keys' work."""

import random
import re

import numpy as np
import pyarrow as pa
import xxhash

from steplens.llm import queries as Q
from steplens.llm import simhash


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(x >> bit & 1 for x in h) > len(h))


def test_every_document(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in Q.op10_simhash_near_dedup(spark, sf_dir).collect()}
    fp = {r["doc_id"]: plain(r["text"]) for r in docs}
    assert {d: r["fingerprint"] for d, r in got.items()} == {d: f"{f:016x}" for d, f in fp.items()}
    root = {d: d for d in fp}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(fp)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fp[a] ^ fp[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {d: r["component_id"] for d, r in got.items()} == {d: find(d) for d in fp}


def test_odd_texts():
    rng = random.Random(1)
    texts = ["", None, " \t\n", "one", "One two", "a b c d", "A\x0bB\x0cC\rD e", "x " * 5000, "é É ß z   y", *(" ".join(rng.choice("abcdeABC") for _ in range(rng.randrange(30))) for _ in range(200))]
    assert simhash.simhash(pa.array(texts, pa.string())).view(np.uint64).tolist() == [plain(t) for t in texts]


def test_all_pairs_within_four_bits_meet():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for _ in base], np.uint64)
    fps = np.unique(np.concatenate([base, base ^ flips])).view(np.int64)
    row, key, near = simhash.fuzzy_keys(fps)
    met, compared = [], 0
    for k in np.unique(key).tolist():
        own = key == k
        u, v, n = simhash.candidates(fps[row[own & near]], fps[row[own]], k >> 12)
        met += zip(u.tolist(), v.tolist(), strict=True)
        compared += n
    parent = {f: f for f in fps.tolist()}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for u, v in met:
        assert (u ^ v).bit_count() <= 64
        parent[find(u)] = find(v)
    a, b = base.view(np.int64).tolist(), (base ^ flips).view(np.int64).tolist()
    close = [(x, y) for x, y, f in zip(a, b, flips.tolist(), strict=True) if f.bit_count() <= 4]
    assert len(close) > 1500 and all(find(x) == find(y) for x, y in close)
    far = [(x, y) for x, y, f in zip(a, b, flips.tolist(), strict=True) if f.bit_count() > 4]
    assert far and all(find(x) != find(y) for x, y in far)
    assert compared < 40 * len(fps)  # mostly each fingerprint with itself; all pairs would be 18 million


def test_a_full_key_is_compared_in_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    base = np.uint64(0x0123456789ABCDEF)
    fps = np.unique(np.append(base ^ np.uint64(1) << rng.integers(22, 64, 400).astype(np.uint64), base)).view(np.int64)  # one first segment
    for few in (1, 1 << 16):
        monkeypatch.setattr(simhash, "FEW", few)
        u, v, compared = simhash.candidates(fps, fps, 0)
        assert len(u) == len(fps) - 1 and set(u.tolist()) | set(v.tolist()) == set(fps.tolist()) and len(set(v.tolist())) == 1
        assert compared >= len(fps) ** 2
