"""Every repeated run of two lines or more goes, but for its first place."""

import random

from pyspark.sql import functions as F

from steplens.llm import line_dedup


def expected(texts):
    """Brute force: (lines kept, lines removed) of each text, in order of doc_id."""
    first, seen = {}, []
    for d, t in enumerate(texts):
        lines = t.split("\n")
        for i in range(len(lines) - 1):
            pair = (lines[i], lines[i + 1])
            if any(x.strip() for x in pair):
                first.setdefault(pair, (d, i))
                seen.append((pair, d, i))
    later = [(d, i) for p, d, i in seen if (d, i) != first[p] and (d, i - 1) != first[p]]
    gone = {(d, j) for d, i in later for j in (i, i + 1)}
    return [[x for i, x in enumerate(t.split("\n")) if (d, i) not in gone] for d, t in enumerate(texts)]


def test_runs_inside_other_documents_go(spark):
    rng = random.Random(8)
    runs = [[f"run {r} line {i}" for i in range(n)] for r, n in enumerate((2, 2, 3, 4, 5, 8) * 4)]
    texts = ["\n".join(x for run in runs for x in [*run, f"between {run[0]}"])]
    for d in range(60):
        lines = [f"own {d} {i}" for i in range(9)]
        at = rng.randrange(1, 8)
        texts.append("\n".join(lines[:at] + rng.choice(runs) + lines[at:]))
    texts += ["a\na\na\na\na", "p\nq", "p\nq\nr", "q\nr", "single\n\n\nx", "y\nsingle\nz", "", "\n\n", texts[5]]
    want = expected(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    for d, t in enumerate(texts):
        n = len(t.split("\n"))
        assert (got[d]["text"], got[d]["n_lines"], got[d]["n_removed"]) == ("\n".join(want[d]), n, n - len(want[d])), d
    assert all(got[d]["n_removed"] in (2, 3, 4, 5, 8) for d in range(1, 61))
    assert got[0]["n_removed"] == 0 and got[len(texts) - 1]["text"] == ""


def table_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)


def agree(spark, texts):
    want = expected(texts)
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(table_of(spark, texts)).collect()}
    for d, t in enumerate(texts):
        n = len(t.split("\n"))
        assert (got[d]["text"], got[d]["n_lines"], got[d]["n_removed"]) == ("\n".join(want[d]), n, n - len(want[d])), d


def test_every_document_against_brute_force(spark, sf_dir):
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    agree(spark, texts)


def test_random_lines_against_brute_force(spark):
    rng = random.Random(3)
    agree(spark, ["\n".join(rng.choice(["", " ", "a", "b", "c", "d", "e", "f"]) for _ in range(rng.randrange(1, 25))) for _ in range(80)])


def test_lines_that_share_their_hashes_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "line_hash", lambda line: (F.length(line).cast("long"), F.lit(0).cast("long")))
    rng = random.Random(5)
    agree(spark, ["\n".join(rng.choice(["aa", "bb", "cc", "d", "e", ""]) for _ in range(rng.randrange(1, 12))) for _ in range(40)])


def test_chunks_stand_alike_wherever_their_lines_do(spark):
    rng = random.Random(9)
    run = [f"run {i}" for i in range(60)]
    texts = ["\n".join([f"own {d} {i}" for i in range(d)] + run + [f"end {d} {i}" for i in range(9 - d)]) for d in range(8)]
    rows = line_dedup.hashed(table_of(spark, texts)).select("_sl_id", line_dedup.chunk_starts(F.col("h")).alias("s")).collect()
    inner = {tuple(i - r["_sl_id"] for i in r["s"] if 3 <= i - r["_sl_id"] < 60) for r in rows}
    assert len(inner) == 1 and len(inner.pop()) > 8 and rng


def test_chunks_decide(spark, sf_dir, monkeypatch):
    """Without chunks nine in ten lines that go would stay: two boundary lines that follow one another are found by chunks alone."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    removed = lambda: line_dedup.dedup_lines(docs).agg(F.sum("n_removed")).first()[0]
    whole = removed()
    with monkeypatch.context() as m:
        m.setattr(line_dedup, "_windows", lambda rows, own=line_dedup._windows: own(rows).limit(0))
        chunks = removed()
    assert chunks >= 0.9 * whole
    with monkeypatch.context() as m:
        m.setattr(line_dedup, "_chunks", lambda rows, own=line_dedup._chunks: own(rows).limit(0))
        assert removed() < 0.7 * whole
