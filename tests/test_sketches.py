"""A sketch that comes out otherwise each time it is worked out, as its parts arrive in another order, changes no result."""

import random

import pytest
from pyspark.sql import functions as F

from steplens.operators import ranking
from steplens.operators.prefix import quantiles, running_by_value


@pytest.fixture
def loose(spark, monkeypatch):
    """``percentile_approx`` off by up to ``by`` at random, worked out anew wherever it is used: down at even places and up at odd
    ones, in ascending order."""

    def patch(by):
        def off(found):
            return found and sorted(v + random.SystemRandom().uniform(0, by) * (1 if i % 2 else -1) for i, v in enumerate(found))

        sketch, moved = F.percentile_approx, F.udf(off, "array<double>").asNondeterministic()
        monkeypatch.setattr(F, "percentile_approx", lambda *a: moved(sketch(*a)))

    spark.conf.set("spark.sql.exchange.reuse", "false")
    yield patch
    spark.conf.unset("spark.sql.exchange.reuse")


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums(spark, loose, descending):
    loose(50.0)
    rows = [(g, float(v), 1 + v % 3) for g in (1, None) for v in range(2000)]
    got = running_by_value(spark.createDataFrame(rows, "g int, v double, n int").repartition(6), ["g"], "v", ["n"], descending, ranges=16).collect()
    assert len(got) == len(rows)
    for g in (1, None):
        upto = 0
        for r in sorted((r for r in got if r["g"] == g), key=lambda r: -r["v"] if descending else r["v"]):
            upto += r["n"]
            assert r["run_n"] == upto and r["all_n"] == sum(n for h, _, n in rows if h == g)


def test_average_precision(spark, loose):
    df = spark.range(2000).selectExpr("id AS tx_id", "CAST(id % 7 = 0 AS INT) AS y", "CAST(id AS DOUBLE) AS score")
    want = 0.0
    for tp, score in enumerate(reversed(range(0, 2000, 7)), 1):
        want += tp / (2000 - score) / 286
    loose(50.0)
    assert ranking.average_precision(df).first()["ap"] == pytest.approx(want, abs=1e-12)


def test_quantiles(spark, loose):
    df = spark.range(5000).selectExpr("id % 2 AS g", "CAST(id AS DOUBLE) AS v").repartition(5)
    want = {r["g"]: r["q"] for r in df.groupBy("g").agg(F.expr("percentile(v, array(0.25, 0.5, 0.9))").alias("q")).collect()}
    loose(200.0)
    got = {r["g"]: r["q"] for r in quantiles(df, ["g"], "v", [0.25, 0.5, 0.9], "q", 100).collect()}
    assert got == {g: pytest.approx(q, abs=1e-9) for g, q in want.items()}
