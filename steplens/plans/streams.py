"""Structured Streaming jobs over the event table, run to the end of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steplens.operators.ranking import ratio
from steplens.plans.registry import query
from steplens.sources.tables import Tables
from steplens.streaming import jobs as S

_Y = "CASE WHEN event_type = 'error' THEN 1 WHEN event_type = 'signup' THEN NULL ELSE 0 END AS y"
_STEP = "CAST(1 + datediff(CAST(ts AS DATE), DATE '2024-01-01') AS INT) AS step"


def stream(t: Tables) -> DataFrame:
    """The event table as a stream of its files."""
    path = f"{t.sf_dir}/events.parquet"
    schema = t.spark.read.parquet(path).schema
    # A pattern: the table may be one file or a folder of files.
    raw = t.spark.readStream.schema(schema).parquet(f"{t.sf_dir}/events.parque[t]")
    return raw.selectExpr("event_id", "user_id", "CAST(ts AS TIMESTAMP) AS ts", "event_type", _STEP, _Y, "least(value / 500, 1) AS score")


def read(t: Tables, path: str, schema: str) -> DataFrame:
    return t.spark.read.schema(schema).parquet(path)


@query("stream_step_stats", """select cast(date_trunc('day', ts) as timestamp)::varchar as start, count(*) n, count(y) labelled, count(*) filter (where y = 1) positive from ev group by 1 having cast(date_trunc('day', min(ts)) as timestamp) + interval 1 day <= (select max(ts) from ev) - interval 1 day""")
def stream_step_stats(t: Tables) -> DataFrame:
    path = S.run_to_end(S.step_stats(stream(t)), "step_stats")
    return read(t, path, "start timestamp, n long, labelled long, positive long").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("stream_label_join", "select event_id, step, (event_id % 4)::bigint delay from ev where event_id % 4 <= 2")
def stream_label_join(t: Tables) -> DataFrame:
    scores = stream(t).select("event_id", "step", "ts")
    labels = stream(t).selectExpr("event_id", "ts + make_dt_interval(CAST(event_id % 4 AS INT)) AS label_ts", "event_id % 4 AS delay")
    path = S.run_to_end(S.label_join(scores, labels, "event_id").select("event_id", "step", "delay"), "label_join")
    return read(t, path, "event_id long, step int, delay long")


@query("stream_late_labels", "select event_id, step, step + event_id % 4 arrival_step, event_id % 4 > 1 late from ev")
def stream_late_labels(t: Tables) -> DataFrame:
    """Labels in time and late ones, which one query writes to a table each, read back."""
    labels = stream(t).selectExpr("event_id", "step", "step + event_id % 4 AS arrival_step")
    path = S.run_to_end(labels, "late", sink=S.late_label_sinks(1))
    kind = "event_id long, step int, arrival_step long"
    both = (t.spark.read.schema(kind).option("recursiveFileLookup", True).parquet(f"{path}/{n}").withColumn("late", F.lit(n == "late")) for n in ("in_time", "late"))
    first, second = both
    return first.unionByName(second)


@query("stream_score_psi", """with b as (select step, least(floor(score * 5), 4) bin, count(*) n from ev group by 1, 2), g as (select distinct step, unnest(range(5)) bin from ev where step > 10), q as (select bin, sum(n) / (select sum(n) from b where step <= 10) q from b where step <= 10 group by 1),
    p as (select g.step, g.bin, greatest(coalesce(n, 0) / sum(coalesce(n, 0)) over (partition by g.step), 1e-4) p, greatest(coalesce(q, 0), 1e-4) q from g left join b on b.step = g.step and b.bin = g.bin left join q on q.bin = g.bin)
    select step, round(sum((p - q) * ln(p / q)), 6) psi from p group by step""")
def stream_score_psi(t: Tables) -> DataFrame:
    bins = F.least(F.floor(F.col("score") * 5), F.lit(4)).cast("int")
    base = S.new_base(t.spark, "psi")
    kept = S.reference_shares(t.ev.where("step <= 10"), bins, f"{base}/reference")

    def write(batch: DataFrame, path: str, epoch: int) -> None:
        reference = batch.sparkSession.read.schema("bin int, q double").parquet(kept)  # five bins
        late = batch.where("step > 10")
        sums = late.groupBy("step").agg(F.sum("n").alias("total"))
        grid = sums.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(4))))
        full = grid.join(late, ["step", "bin"], "left").join(F.broadcast(reference), "bin", "left")
        p, q = F.greatest(ratio(F.coalesce("n", F.lit(0)), F.col("total")), F.lit(1e-4)), F.greatest(F.coalesce("q", F.lit(0.0)), F.lit(1e-4))
        full.groupBy("step").agg(F.round(F.sum((p - q) * F.ln(p / q)), 6).alias("psi")).write.mode("overwrite").parquet(path)

    path = S.run_to_end(S.score_histogram_stream(stream(t), bins), "psi", "complete", sink=write, base=base)
    return read(t, path, "step int, psi double")


@query("stream_trigger_state", """with d as (select event_type, step, hit, sum(case when hit then 0 else 1 end) over (partition by event_type order by step) g from (select event_type, 1 + date_diff('day', date '2024-01-01', cast(ts as date)) step, avg(value) > 100 hit from events group by 1, 2))
    select event_type, step, sum(case when hit then 1 else 0 end) over (partition by event_type, g order by step)::bigint streak from d""")
def stream_trigger_state(t: Tables) -> DataFrame:
    """Streaks by typed state and timers; a row of no monitor from long after the end lets the last steps pass the watermark."""
    raw = t.raw("events").selectExpr("event_type", _STEP, "value")
    end = F.expr("CAST(DATE '2024-01-01' AS TIMESTAMP) + make_dt_interval(step)").alias("end_ts")
    stats = raw.groupBy("event_type", "step").agg((F.avg("value") > 100).alias("hit")).select("event_type", "step", "hit", end)
    closing = stats.agg(F.max("step").alias("step"), F.max("end_ts").alias("end_ts")).selectExpr("CAST(NULL AS STRING) AS event_type", "step + 1000 AS step", "false AS hit", "end_ts + INTERVAL 1000 DAYS AS end_ts")
    base = S.new_base(t.spark, "streaks")
    stats.unionByName(closing).write.parquet(f"{base}/stats")
    source = t.spark.readStream.schema("event_type string, step int, hit boolean, end_ts timestamp").parquet(f"{base}/stats")
    out = S.run_to_end(S.trigger_streaks(source, "event_type", "step", "hit", "end_ts"), "streaks", base=base, rocks=True)
    return read(t, out, "event_type string, step int, streak int").withColumn("streak", F.col("streak").cast("long"))


@query("stream_dedup", "select event_id, step from ev")
def stream_dedup(t: Tables) -> DataFrame:
    twice = stream(t).select("event_id", "step", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    path = S.run_to_end(S.dedup(twice, ["event_id"]).select("event_id", "step"), "dedup")
    return read(t, path, "event_id long, step int")


@query("stream_prediction_log", "select step, count(*) n, round(sum(score), 4) total from ev group by step")
def stream_prediction_log(t: Tables) -> DataFrame:
    path = S.run_to_end(stream(t).select("event_id", "step", "score"), "log", form="json")
    log = t.spark.read.schema("event_id long, step int, score double").json(path)
    return log.groupBy("step").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total"))
