"""As-of joins and lags over segments against plain readings, with one key that holds half of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from steplens.operators.joins import asof_prior_snapshot
from steplens.operators.windows import lag_k

rng = random.Random(11)
KEYS = ["hot"] * 6 + ["a", "b", None, "quiet"]
EVENTS = [(i, rng.choice(KEYS), rng.choice([*range(1, 300), None])) for i in range(1500)]
SNAPS = [(rng.choice(KEYS[:-1]), rng.choice(range(1, 300, 3)), rng.randrange(1000)) for _ in range(500)]


@pytest.mark.parametrize("segment", [1, 7, 64, 1000])
def test_asof_against_a_plain_reading(spark, segment):
    events = spark.createDataFrame(EVENTS, "id long, k string, step int").repartition(3)
    snaps = spark.createDataFrame(SNAPS, "k string, step int, v int")
    got = {r["id"]: (r["prior_step"], r["prior_value"]) for r in asof_prior_snapshot(events, snaps, "k", "step", "v", segment=segment).collect()}
    assert len(got) == len(EVENTS)
    for i, k, step in EVENTS:
        past = [(s, v) for kk, s, v in SNAPS if kk == k and step is not None and s < step]
        assert got[i] == (max(past) if past else (None, None))


def test_a_hot_key_is_no_task_of_its_own(spark):
    """Half a million events of one address: the windows see its steps, and the rows are dealt over all tasks."""
    events = spark.range(500_000).select("id", F.lit("hot").alias("k"), (F.col("id") % 49).cast("int").alias("step"))
    snaps = spark.range(1000).select(F.lit("hot").alias("k"), (F.col("id") % 49).cast("int").alias("step"), F.col("id").alias("v"))
    found = asof_prior_snapshot(events, snaps, "k", "step", "v")
    assert found.where("prior_step = step - 1").count() == found.where("step > 0").count() == found.where("prior_value IS NOT NULL").count()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in asof_prior_snapshot(events, snaps, "k", "step", "v").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) <= 0.6 * sum(sizes)


@pytest.mark.parametrize("rows", [3, 40, 3000])
def test_lags_against_a_plain_reading(spark, rows):
    data = [(rng.choice(KEYS), rng.randrange(50), i, rng.choice([None, i])) for i in range(rows)]
    df = spark.createDataFrame(data, "k string, step int, id int, v int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["id"]: (r["v_lag1"], r["v_lag5"]) for r in lag_k(df, "k", ["step", "id"], "v", [1, 5]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == rows
    for k in {r[0] for r in data}:
        own = sorted((r for r in data if r[0] == k), key=lambda r: r[1:3])
        for n, r in enumerate(own):
            assert got[r[2]] == (own[n - 1][3] if n >= 1 else None, own[n - 5][3] if n >= 5 else None)
