"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steplens.plans.registry import query
from steplens.sources import readers
from steplens.sources.scratch import folder
from steplens.sources.tables import Tables


def _fresh(t: Tables, name: str) -> str:
    return f"{folder(t.spark, name)}/data"


@query("scan_typed", "select tx_id, step, cls, price from tx")
def scan_typed(t: Tables) -> DataFrame:
    path = _fresh(t, "csv")
    t.tx.select("tx_id", "step", "cls", "price").write.option("header", True).csv(path)
    return readers.scan_typed(t.spark, path, "tx_id long, step int, cls int, price double")


@query("scan_malformed", "select count(*) malformed, min(tx_id) first_id, max(tx_id) last_id from tx where tx_id % 97 = 0")
def scan_malformed(t: Tables) -> DataFrame:
    path = _fresh(t, "lines")
    extra = F.when(F.col("tx_id") % 97 == 0, F.concat_ws(",", "tx_id", "step", "cls", F.lit("x"))).otherwise(F.concat_ws(",", "tx_id", "step", "cls"))
    t.tx.select(extra.alias("value")).write.text(path)
    rows = readers.scan_malformed(t.spark, path, "tx_id long, step int, cls int")
    return rows.agg(F.count(readers.CORRUPT).alias("malformed"), F.min("tx_id").alias("first_id"), F.max("tx_id").alias("last_id"))


@query("scan_pruned", "select o_orderkey, o_totalprice from orders")
def scan_pruned(t: Tables) -> DataFrame:
    return readers.scan_pruned(t.raw("orders"), ["o_orderkey", "o_totalprice"])


@query("scan_filter_stream", "select tx_id, step, score from tx where step between 35 and 42 and tx_id in (select tx_id from tx_addr)")
def scan_filter_stream(t: Tables) -> DataFrame:
    return readers.scan_filter(t.tx, (35, 42), t.tx_addr).select("tx_id", "step", "score")


@query("scan_decisions_json", "select step, cast(round(avg(score), 6) as double) mean_score, count(*) n from tx where step = 49 group by step")
def scan_decisions_json(t: Tables) -> DataFrame:
    path = _fresh(t, "json")
    by_step = t.tx.groupBy("step").agg(F.round(F.avg("score"), 6).alias("mean_score"), F.count("*").alias("n"))
    by_step.agg(F.collect_list(F.struct("step", "mean_score", "n")).alias("decisions")).coalesce(1).write.json(path)
    rows = readers.scan_decisions(t.spark, path)
    return rows.agg(F.max_by(F.struct("step", "mean_score", "n"), "step").alias("d")).selectExpr("cast(d.step as int) AS step", "d.mean_score", "d.n")


@query("sink_tables", "select step, count(*) n from tx group by step")
def sink_tables(t: Tables) -> DataFrame:
    path = _fresh(t, "tables")
    readers.sink_tables({"steps": t.tx.groupBy("step").agg(F.count("*").alias("n"))}, path)
    return t.spark.read.parquet(f"{path}/steps")


@query("sink_strict_json", "select tx_id, case when tx_id % 10 = 0 then null else score end score from tx")
def sink_strict_json(t: Tables) -> DataFrame:
    path = _fresh(t, "strict")
    bad = F.when(F.col("tx_id") % 20 == 0, F.lit(float("nan"))).when(F.col("tx_id") % 10 == 0, F.lit(float("inf"))).otherwise(F.col("score"))
    readers.sink_strict_json(t.tx.select("tx_id", bad.alias("score")), path)
    return t.spark.read.schema("tx_id long, score double").json(path)


@query("sink_prediction_log", "select model_version, count(*) n, min(tx_id) first_tx from (select 'v1' model_version, tx_id from tx union all select 'v2', tx_id from tx where step > 40) group by 1")
def sink_prediction_log(t: Tables) -> DataFrame:
    path = _fresh(t, "log")
    readers.sink_prediction_log(t.tx.select("tx_id", "step", "score"), path, "v1")
    readers.sink_prediction_log(t.tx.where("step > 40").select("tx_id", "step", "score"), path, "v2")
    log = t.spark.read.schema("logged_at timestamp, model_version string, tx_id long, step int, score double").json(path)
    return log.groupBy("model_version").agg(F.count("*").alias("n"), F.min("tx_id").alias("first_tx"))


_RICH = "with c as (select step, count(*) filter (where y = 1) positive from tx group by step), w as (select step from c where positive > (select avg(positive) from c))"


@query("scan_step_layout", f"{_RICH} select step, count(*) n, round(sum(price), 2) total from tx where step in (select step from w) group by step")
def scan_step_layout(t: Tables) -> DataFrame:
    """Transactions laid out by step, of which only the folders of steps with more positives than the mean are read."""
    path = _fresh(t, "by_step")
    readers.sink_by_step(t.tx.select("tx_id", "step", "price"), path)
    counts = t.tx.groupBy("step").agg(F.count_if(F.col("y") == 1).alias("positive"))
    wanted = counts.crossJoin(F.broadcast(counts.agg(F.avg("positive").alias("mean")))).where("positive > mean")  # one row
    laid = t.spark.read.schema("tx_id long, price double, step int").parquet(path)
    return readers.scan_steps(laid, wanted).groupBy("step").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total"))
