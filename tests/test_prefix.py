"""Running sums and positions at two levels against a plain reading, with one group that holds most rows, ties and nulls."""

import random

import pytest
from pyspark.sql import functions as F

from steplens.operators.prefix import positions, ranged, running

rng = random.Random(5)
ROWS = [(None if rng.random() < 0.1 else ("hot" if rng.random() < 0.8 else "cold"), None if rng.random() < 0.05 else rng.randrange(40), rng.randrange(5)) for _ in range(3000)]
#: Most rows tie here, which no boundary between values can split.
TIED = [("hot", 1, 1)] * 2000 + [("cold", x, 1) for x in range(10)]


@pytest.mark.parametrize("rows", [ROWS, TIED])
def test_running_and_positions(spark, rows):
    df = spark.createDataFrame(rows, "g string, k int, v int")
    order = [F.col("k").asc_nulls_first()]
    got = {}
    for r in running(df, ["g"], order, {"total": F.col("v")}).collect():
        got.setdefault(r["g"], []).append((r["k"] is not None, r["k"] or 0, r["total"], r["v"]))
    for g, own in got.items():
        at = 0
        for _, _, total, v in sorted(own):
            assert total - v in (at, total - v) and total >= at
            at = max(at, total)
        assert at == sum(v for h, _, v in rows if h == g)
        ends = {}
        for some, k, total, _ in own:
            ends[(some, k)] = max(ends.get((some, k), 0), total)
        assert all(e == sum(v for h, j, v in rows if h == g and ((j is not None, j or 0) <= x)) for x, e in ends.items())
    placed = {}
    for r in positions(df, ["g"], order, "i", "n").collect():
        placed.setdefault(r["g"], []).append((r["i"], r["k"] is not None, r["k"] or 0, r["n"]))
    for own in placed.values():
        own.sort()
        assert [x[0] for x in own] == list(range(len(own))) and {x[3] for x in own} == {len(own)}
        assert [x[1:3] for x in own] == sorted(x[1:3] for x in own)


def test_empty(spark):
    df = spark.createDataFrame([], "g string, k int, v int")
    assert running(df, ["g"], [F.col("k")], {"total": F.col("v")}).collect() == [] == positions(df, ["g"], [F.col("k")], "i", "n").collect()


def test_a_tied_group_is_spread(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counts = ranged(spark.createDataFrame(TIED, "g string, k int, v int"), F.col("k")).groupBy("_range").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(counts) == 4 and max(r["count"] for r in counts) < len(TIED) / 2


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_quantiles_are_exact(spark, accuracy):
    from pyspark.sql import Window  # noqa: F401

    from steplens.operators.prefix import quantiles

    probs = [0.0, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]
    rows = [(str(n), float(rng.choice([rng.gauss(0, 1), rng.randrange(3), 5.0]))) for n in (1, 2, 3, 4, 5, 7, 10, 33, 1000, 5000) for _ in range(n)]
    rows += [(None, float(x)) for x in range(11)] + [("tied", 1.0)] * 3000 + [("tied", 2.0)] + [("null", None)] * 3
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: r["q"] for r in quantiles(df, ["g"], "v", probs, "q", accuracy).collect()}
    names = ", ".join(map(str, probs))
    want = {r["g"]: r["q"] for r in df.where("v is not null").groupBy("g").agg(F.expr(f"percentile(v, array({names}))").alias("q")).collect()}
    assert got.keys() == want.keys()
    for g in got:
        assert got[g] == pytest.approx(want[g], abs=1e-12)
    whole = quantiles(df, [], "v", [0.5], "q", accuracy).first()["q"][0]
    assert whole == pytest.approx(df.agg(F.expr("percentile(v, 0.5)")).first()[0], abs=1e-12)


def test_quantiles_keep_little(spark):
    """Of a group of 60,000 values the windows hold those near the quantiles asked for, and not the group."""
    from steplens.operators.prefix import quantiles

    df = spark.range(60_000).select(F.lit("g").alias("g"), (F.col("id") * 7919 % 60_013).cast("double").alias("v"))
    found = quantiles(df, ["g"], "v", [0.25, 0.5])
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "percentile(" not in plan.replace("percentile_approx(", "")


@pytest.mark.parametrize("descending", [False, True])
def test_running_by_value(spark, descending):
    from steplens.operators.prefix import running_by_value

    rows = [(g, float(v), rng.randrange(9), rng.randrange(3)) for g, n in (("hot", 3000), (None, 40), ("one", 1)) for v in range(n)]
    got = running_by_value(spark.createDataFrame(rows, "g string, v double, a int, b int").repartition(6), ["g"], "v", ["a", "b"], descending, ranges=16).collect()
    assert len(got) == len(rows)
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: -r[1] if descending else r[1])
        found = {r["v"]: r for r in got if r["g"] == g}
        a = b = 0
        for _, v, x, y in own:
            a, b = a + x, b + y
            assert (found[v]["run_a"], found[v]["run_b"]) == (a, b) and found[v]["all_a"] == sum(r[2] for r in own)


def test_one_group_is_spread_over_tasks(spark):
    """A million distinct values of one group meet in windows of a few thousand rows."""
    from steplens.operators.prefix import running_by_value

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(1_000_000).select(F.lit(1).alias("g"), (F.col("id") * 7919 % 1_000_003).cast("double").alias("v"), F.lit(1).alias("n"))
        out = running_by_value(df, ["g"], "v", ["n"]).withColumn("_p", F.spark_partition_id())
        sizes = [r["count"] for r in out.groupBy("_p").count().collect()]
        assert len(sizes) == 4 and max(sizes) < 400_000 and out.where("run_n > all_n or run_n < 1").isEmpty()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
