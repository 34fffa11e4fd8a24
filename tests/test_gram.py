"""Correlations by matrix products against Spark's own, with missing cells, and at the width of wide feature tables."""

import random
import time

import pytest
from pyspark.sql import functions as F

from steplens.operators.gram import correlations, pair_sums


def test_against_corr(spark):
    rng = random.Random(3)
    odd = [None, float("nan"), float("inf"), -float("inf")]
    rows = [tuple(rng.choice(odd) if rng.random() < 0.1 else 1e6 + rng.gauss(0, 1) * (k + 1) + (rng.random() if k else 0) for k in range(4)) + (3.0,) for _ in range(500)]
    names = ["a", "b", "c", "d", "same"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(3)
    for r in correlations(df, names).collect():
        if "same" in (r["a"], r["b"]):
            assert r["r"] is None
            continue
        both = df.where(f"abs({r['a']}) < double('inf') and abs({r['b']}) < double('inf')")
        want = both.agg(F.corr(r["a"], r["b"])).first()[0]
        assert r["r"] == pytest.approx(want, abs=1e-9)


def test_none_and_one_row(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert [r["r"] for r in correlations(df, ["a", "b"]).collect()] == [None]
    assert correlations(df.limit(0), ["a", "b"]).collect() == [] == pair_sums(df, ["a"]).collect()


def test_165_columns(spark, sf_dir):
    base = spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/embeddings.parquet")
    n = len(base.first()["embedding"])
    columns = [f"c{k}" for k in range(165)]
    df = base.select(*[(F.get("embedding", F.lit(k % n)) + F.get("embedding", F.lit(k * 7 % n)) * (k // n)).alias(c) for k, c in enumerate(columns)])
    began = time.perf_counter()
    rows = correlations(df, columns).collect()
    assert len(rows) == 165 * 164 // 2 and time.perf_counter() - began < 20  # under 10 s on a machine that does nothing else
    some = {(r["a"], r["b"]): r["r"] for r in rows}
    assert some["c3", "c160"] == pytest.approx(df.agg(F.corr("c3", "c160")).first()[0], abs=1e-9)
