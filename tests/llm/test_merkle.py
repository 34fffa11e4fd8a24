"""Merkle manifests against trees built in plain Python: sizes around powers of three, hot sources, nulls, repeated rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from steplens.llm import merkle

KINDS = "doc_id long, source string, lang string, n_chars long, text string, g string, h string, i int, n int, leaf string, steps int, b int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[1], row[2], row[3], row[4])])


def tree(hashes):
    """(root, siblings of each leaf by level as (left, right))."""
    paths, at, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        for k, p in enumerate(at):
            lo = p - p % 3
            paths[k].append(("".join(level[lo:p]), "".join(level[p + 1 : lo + 3])))
        level = [H(*level[j : j + 3]) for j in range(0, len(level), 3)]
        at = [p // 3 for p in at]
    return level[0], paths


def plain(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    subs, out = {}, []
    for s in sources:
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subs[s] = (own, *tree([leaf(r) for r in own]))
    root, tops = tree([subs[s][1] for s in sources])
    for k, s in enumerate(sources):
        for r, path in zip(subs[s][0], subs[s][2], strict=True):
            out.append((r[0], leaf(r), subs[s][1], root, "".join(a + b for a, b in path + tops[k])))
    return sorted(map(str, out))


def rows_of(counts, seed=1):
    rng, rows = random.Random(seed), []
    for s, n in counts.items():
        for _ in range(n):
            rows.append((rng.choice([None, *range(-3, 3 * n)]), s, rng.choice(["en", None, ""]), rng.choice([1, None]), rng.choice([None, "", "é\n\n", "text " * 30 + str(rng.random())]), *("x", "y", 1, 2, "z", 3, 4)))
    return rows


@pytest.mark.parametrize("counts", [{"a": 1}, {"a": 2, None: 1}, {"a": 3, "b": 4, "c": 9, "": 10}, {"é": 27, "z": 28, None: 26, "hot": 900}, {f"s{i}": 1 + i % 3 for i in range(31)}])
def test_against_plain_trees(spark, monkeypatch, counts):
    monkeypatch.setattr(merkle, "LEVELS", 2)  # several passes
    rows = rows_of(counts)
    rows += rows[:2] * 3  # rows alike in all
    found = merkle.verify(merkle.manifest(spark.createDataFrame(rows, KINDS)))
    got = found.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("steps")), "verified").collect()
    assert sorted(str(tuple(r)[:5]) for r in got) == plain(rows) and all(r["verified"] for r in got)


def test_blocks_of_the_production_size(spark):
    rows = [(i, "hot", "en", 1, str(i), *("x", "y", 1, 2, "z", 3, 4)) for i in range(2200)]
    found = merkle.verify(merkle.manifest(spark.createDataFrame(rows, KINDS)))
    got = found.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("steps")), "verified").collect()
    assert sorted(str(tuple(r)[:5]) for r in got) == plain(rows) and all(r["verified"] for r in got)


def test_tampering_shows(spark):
    rows = rows_of({"a": 40, "b": 5}, 2)
    docs = spark.createDataFrame(rows, KINDS)
    cut = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    found = {}
    for r in merkle.verify(merkle.manifest(docs, cut)).collect():
        found.setdefault(r["leaf"], set()).add(r["verified"])
    assert all(found[leaf(r)] == {"\n" not in (r[4] or "")} for r in rows) and {True} in found.values() and {False} in found.values()


def test_empty_table(spark):
    assert merkle.verify(merkle.manifest(spark.createDataFrame([], KINDS))).collect() == []
