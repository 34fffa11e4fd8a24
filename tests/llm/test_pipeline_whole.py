"""The pipeline against a plain reading of its stages, and each stage on odd tables."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from steplens.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def without_repeated_lines(texts):
    first, seen = {}, []
    for d in sorted(texts):
        lines = texts[d].split("\n")
        for i in range(len(lines) - 1):
            if lines[i].strip() or lines[i + 1].strip():
                first.setdefault((lines[i], lines[i + 1]), (d, i))
                seen.append(((lines[i], lines[i + 1]), d, i))
    gone = {(d, j) for p, d, i in seen if (d, i) != first[p] and (d, i - 1) != first[p] for j in (i, i + 1)}
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in texts.items()}


def one_of_each(texts):
    sets = {}
    for d, t in texts.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in texts:
        for b in texts:
            if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {d: t for d, t in texts.items() if find(d) == d}


def without_repeated_windows(texts, size=35):
    words = {d: list(WORD.finditer(t)) for d, t in texts.items()}
    found = Counter(tuple(m[0] for m in w[i : i + size]) for w in words.values() for i in range(len(w) - size + 1))
    out = {}
    for d, w in words.items():
        gone = {i + k for i in range(len(w) - size + 1) if found[tuple(m[0] for m in w[i : i + size])] > 1 for k in range(size)}
        ends = ([m.start() for m in w[1:]] + [len(texts[d])])[: len(w)]
        out[d] = texts[d][: w[0].start() if w else None] + "".join(texts[d][m.start() : e] for i, (m, e) in enumerate(zip(w, ends, strict=True)) if i not in gone)
    return out


def test_run_against_a_plain_reading(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.collect()
    ranker = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = ranker(quality.features(pa.array([r["text"] or "" for r in rows])))
    texts = {r["doc_id"]: r["text"] for r, s in zip(rows, scores, strict=True) if s >= quality.CUT}
    assert 0 < len(texts) < len(rows)
    texts = without_repeated_windows(one_of_each(without_repeated_lines(texts)))
    tokenizer, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {}
    for d, t in texts.items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        for k in range(-(-len(ids) // 2048)):
            piece = ids[2048 * k : 2048 * (k + 1)]
            want[d, k] = (2048 * k, len(piece), zlib.crc32(piece.tobytes()))
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    for number in {r["sequence_id"] for r in got}:
        at = 0
        for r in sorted((r for r in got if r["sequence_id"] == number), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_on_odd_tables(spark, sf_dir, name, stage):
    long = " ".join(f"word{i}" for i in range(60_000))
    rows = [(1, "a b c d e f\nsecond line of it\nthird line of it"), (2, None), (3, ""), (3, ""), (None, "no id at all"), (4, long), (5, "a b c d e f\nsecond line of it\nthird line of it"), (5, "another text of one id"), (5, "another text of one id")]
    clash = ["lang", "n_lines", "n_removed", "runs", "h", "node", "fp", "bands", "score", "key", "_sl_id", "n_words", "bucket"]
    table = spark.createDataFrame([(*r, len(r[1] or ""), *range(len(clash))) for r in rows], "doc_id long, text string, n_chars long, " + ", ".join(f"{c} int" for c in clash)).repartition(3)
    out = stage(spark, table, sf_dir)
    assert out.columns == table.columns
    got = out.collect()
    assert all(r[c] == i for r in got for i, c in enumerate(clash))
    assert all(r["n_chars"] == len(r["text"] or "") or r["text"] is None for r in got)
    if name in ("line_dedup", "substring_dedup"):
        assert len(got) == len(rows)
    empty = stage(spark, table.limit(0), sf_dir)
    assert empty.columns == table.columns and empty.collect() == []
