"""Streams: steps out of order between batches, restarts, initial state, and two sinks that write each batch once."""

import datetime as dt
import os

import pytest

from steplens.streaming import jobs as S

DAY = dt.datetime(2024, 1, 1)
KIND = "k string, step int, hit boolean, end timestamp"


def put(spark, base, rows, n):
    """One more file of the source; a row without a monitor moves the watermark."""
    data = [(k, s, h, DAY + dt.timedelta(days=s)) for k, s, h in rows]
    spark.createDataFrame(data, KIND).coalesce(1).write.mode("append").parquet(f"{base}/in")
    assert len([f for f in os.listdir(f"{base}/in") if f.endswith(".parquet")]) == n


def streaks(spark, base, **more):
    source = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    out = S.run_to_end(S.trigger_streaks(source, "k", "step", "hit", "end", **more), "t", base=base, rocks=True)
    return sorted((r["k"], r["step"], r["streak"]) for r in spark.read.schema("k string, step int, streak int").parquet(out).collect())


@pytest.fixture
def base(spark, tmp_path):
    return str(tmp_path)


def test_steps_out_of_order_between_batches_and_restarts(spark, base):
    put(spark, base, [("a", 1, True), ("a", 3, True), ("b", 1, True)], 1)
    put(spark, base, [("a", 2, True), ("b", 3, True)], 2)  # step 2 of a comes after its step 3
    first = streaks(spark, base, late="5 days")
    assert first == []  # nothing is sure yet
    put(spark, base, [("a", 4, False), ("a", 5, True), (None, 10, False)], 3)
    second = streaks(spark, base, late="5 days")  # goes on from the checkpoint
    assert second == [("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("a", 4, 0), ("a", 5, 1), ("b", 1, 1), ("b", 3, 1)]
    put(spark, base, [("a", 6, True), (None, 40, False)], 4)
    assert streaks(spark, base, late="5 days") == sorted([*second, ("a", 6, 2)])


def test_initial_state(spark, base):
    put(spark, base, [("a", 8, True), ("b", 8, True), ("c", 8, True), (None, 400, False)], 1)
    initial = spark.createDataFrame([("a", 7, 7), ("b", 3, 5)], "k string, streak int, last int")
    assert streaks(spark, base, initial=initial) == [("a", 8, 8), ("b", 8, 1), ("c", 8, 1)]


def test_a_batch_that_comes_again_adds_no_row(spark, base):
    labels = spark.createDataFrame([(i, i % 5, i % 5 + i % 3) for i in range(30)], "id long, step int, arrival_step int")
    sink = S.late_label_sinks(1)
    for _ in range(3):
        sink(labels, f"{base}/out", 0)
    sink(labels.limit(3), f"{base}/out", 1)
    counts = {n: spark.read.option("recursiveFileLookup", True).parquet(f"{base}/out/{n}").count() for n in ("in_time", "late")}
    late = labels.where("arrival_step - step > 1").count()
    assert counts["in_time"] + counts["late"] == 33 and late <= counts["late"] <= late + 3


def test_a_job_keeps_the_reference_it_was_given(spark, base):
    from pyspark.sql import functions as F

    scores = spark.range(100).select((F.col("id") / 100).alias("score"))
    bins = F.floor(F.col("score") * 5).cast("int")
    one = S.reference_shares(scores, bins, f"{base}/reference")
    two = S.reference_shares(scores.where("score < 0.2"), bins, f"{base}/reference", version=2)
    assert {r["bin"]: r["q"] for r in spark.read.parquet(one).collect()} == {i: 0.2 for i in range(5)}
    assert [tuple(r) for r in spark.read.parquet(two).select("bin", "q").collect()] == [(0, 1.0)]
