"""The registered queries on the smallest tables: oracle SQL, brute force and held-out accuracy."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from steplens.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    df = Q.queries()[name](spark, sf_dir)
    found = con.execute(Q.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(str([r[names.index(c)] for c in df.columns]) for r in found.fetchall()) == sorted(str(list(r)) for r in df.collect())


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_quality_held_out(spark, sf_dir, size):
    sf_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), size)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = Q.op3_quality_classifier(spark, sf_dir).join(labels, "doc_id").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert held and sum(r["predicted"] == r["quality"] for r in held) / len(held) >= 0.95
    good, bad = ([r["score"] for r in held if r["quality"] == y] for y in (1, 0))
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / len(good) / len(bad)
    assert auc >= 0.98 and sum(b < 0.3 for b in bad) >= 0.9 * len(bad)


def test_fingerprint_edits(spark, sf_dir):
    docs = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), key=lambda r: -r["doc_id"])
    got = {r["doc_id"]: r for r in Q.op6_exact_fingerprints(spark, sf_dir).collect()}
    prints = {}
    for i, r in enumerate(docs):
        after, third = docs[(i + 1) % len(docs)]["text"], len(r["text"]) // 3
        edited = r["text"][: len(r["text"]) - third] + after[:third]
        assert got[r["doc_id"]]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(r["text"], got[r["doc_id"]]["fingerprint"]) == got[r["doc_id"]]["fingerprint"]


def test_neighbours_recall(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    got = {}
    for r in Q.op7_nearest_neighbours(spark, sf_dir).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(got[ids[q]] & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
    assert hits / (20 * len(got)) >= 0.9


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = docs
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, sf_dir)
        assert out.columns == docs.columns, name
        rows = out.collect()
        counts.append(len(rows))
        assert all(r["n_chars"] == len(r["text"]) for r in rows if name in ("line_dedup", "substring_dedup"))
        out = spark.createDataFrame(rows, docs.schema)
    assert counts[0] > counts[1] == counts[2] > counts[3] == counts[4]
    ids = {r["doc_id"] for r in out.collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, out, sf_dir).collect()
    assert {r["doc_id"] for r in packed} == ids
