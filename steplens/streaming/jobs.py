"""Structured Streaming jobs with the semantics of the batch operators. Each takes a stream and returns a stream, or runs
one to the end of what its source holds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from steplens.sources.scratch import folder

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def new_base(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one, for a job's output, checkpoints and tables."""
    return folder(spark, f"stream-{name}")


def run_to_end(stream: DataFrame, name: str, mode: str = "append", form: str = "parquet", sink: Callable | None = None, base: str | None = None, rocks: bool = False) -> str:
    """Process all that is there in the shared folder's name and stop; the path of the output. Checkpoints lie beside it,
    so a restart with the same ``base`` goes on where it was. ``sink`` gets each batch, the path and the batch's number; ``rocks`` keeps
    state in RocksDB, which typed state and timers need."""
    spark = stream.sparkSession
    base = base or new_base(spark, name)
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    if rocks:
        spark.conf.set(key, ROCKS)
    try:
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
        job = writer.foreachBatch(lambda df, epoch: sink(df, f"{base}/out", epoch)).start() if sink else writer.format(form).option("path", f"{base}/out").start()
        job.awaitTermination()
    finally:
        spark.conf.set(key, before)
    return f"{base}/out"


def step_stats(events: DataFrame, ts: str = "ts", late: str = "1 day", width: str = "1 day", y: str = "y") -> DataFrame:
    """Rows, labelled rows and positives of each tumbling step; a step is given once it can get no more rows."""
    w = F.window(ts, width)
    out = events.withWatermark(ts, late).groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.count(y).alias("labelled"), F.count_if(F.col(y) == 1).alias("positive"))
    return out.select(F.col("w.start").alias("start"), "n", "labelled", "positive")


def label_join(scores: DataFrame, labels: DataFrame, key: str, most: str = "2 days") -> DataFrame:
    """Scores (key, ts, ...) with labels (key, label_ts, ...) that arrive within a time of them; state older is dropped."""
    s = scores.withWatermark("ts", "1 day")
    r = labels.withColumnRenamed(key, "_key").withWatermark("label_ts", "1 day")
    return s.join(r, F.expr(f"{key} = _key AND label_ts >= ts AND label_ts <= ts + INTERVAL {most}")).drop("_key")


def split_late(labels: DataFrame, lag: int, step: str = "step", arrival: str = "arrival_step") -> tuple[DataFrame, DataFrame]:
    """(labels in time, labels that took longer than ``lag`` steps)."""
    late = F.col(arrival) - F.col(step) > lag
    return labels.where(~late), labels.where(late)


def write_once(df: DataFrame, path: str, epoch: int) -> bool:
    """Write a batch under its number, unless a run before this one has: a batch that is given again adds no row. The folder of a batch is
    written whole, as Spark renames it when its job commits, and marked by _SUCCESS."""
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={epoch}/_SUCCESS")
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return False
    df.write.mode("overwrite").parquet(f"{path}/batch={epoch}")
    return True


def late_label_sinks(lag: int, step: str = "step", arrival: str = "arrival_step") -> Callable[[DataFrame, str, int], None]:
    """A sink of two tables in one query: labels that came in time under ``in_time`` and the others under ``late``, each batch once."""

    def write(batch: DataFrame, path: str, epoch: int) -> None:
        kept = batch.persist()
        try:
            for name, part in zip(("in_time", "late"), split_late(kept, lag, step, arrival), strict=True):
                write_once(part, f"{path}/{name}", epoch)
        finally:
            kept.unpersist()

    return write


def score_histogram_stream(scores: DataFrame, bins: Column, step: str = "step") -> DataFrame:
    """Rows of each step and bin so far, for complete mode."""
    return scores.groupBy(step, bins.alias("bin")).agg(F.count("*").alias("n"))


def dedup(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 day") -> DataFrame:
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def reference_shares(scores: DataFrame, bins: Column, path: str, version: int = 1) -> str:
    """Write the share of each bin of reference scores as version ``version`` under ``path`` and return that folder. A job names the version
    that it reads, so a later reference changes nothing that runs."""
    counts = scores.groupBy(bins.alias("bin")).agg(F.count("*").alias("r"))
    place = f"{path}/version={version}"
    counts.crossJoin(F.broadcast(counts.agg(F.sum("r").alias("all")))).select("bin", (F.col("r") / F.col("all")).alias("q")).write.mode("overwrite").parquet(place)  # one row
    return place


def trigger_streaks(stats: DataFrame, key: str, step: str, hit: str, end: str, late: str = "0 seconds", keep: int | None = None, initial: DataFrame | None = None) -> DataFrame:
    """(key, step, streak): consecutive hits of each monitor up to its step, carried on from batch to batch.

    A step waits in a map until the watermark of ``end``, the time at which it ends, has passed it by ``late``; a timer then takes all
    that wait in their order. So steps may come in any order within that delay, between batches too; what comes later than that is
    left out, and of a step that comes twice the last one counts. A gap between steps ends a streak. A row of no monitor moves the
    watermark and no more. ``initial`` (key, streak, last)
    says where monitors stand at the start. ``keep`` milliseconds after its last step a monitor's state is given up."""
    kind = stats.schema[key].dataType.simpleString()
    gone, name = int(keep) if keep else 0, key

    class Streaks(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.now = handle.getValueState("now", "streak int, last int")
            self.waiting = handle.getMapState("waiting", "step int", "hit boolean, due long")

        def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
            last = self.now.get()[1] if self.now.exists() else None
            for row in rows if key[0] is not None else []:
                if last is None or row[step] > last:
                    due = int(row["_due"])
                    self.waiting.updateValue((row[step],), (bool(row[hit]), due))
                    self.handle.registerTimer(due)
            return iter([])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
            at = expiredTimerInfo.getExpiryTimeInMs()
            ready = sorted((s[0], v[0], v[1]) for s, v in self.waiting.iterator() if v[1] <= at)
            if not ready:
                if gone and self.now.exists():
                    self.now.clear()
                return
            streak, last = self.now.get() if self.now.exists() else (0, None)
            for s, h, _ in ready:
                streak = (streak + 1 if last is None or s == last + 1 else 1) if h else 0
                last = s
                self.waiting.removeKey((s,))
                yield Row(**{name: key[0], step: s, "streak": streak})
            self.now.update((streak, last))
            if gone:
                self.handle.registerTimer(max(d for _, _, d in ready) + gone)

        def handleInitialState(self, key, initialState, timerValues):  # noqa: N802, N803
            self.now.update((initialState["streak"], initialState["last"]))

        def close(self) -> None:
            pass

    timed = stats.select(key, step, hit, end, F.unix_millis(end).alias("_due")).withWatermark(end, late)
    start = initial.select(key, "streak", "last").groupBy(key) if initial is not None else None
    return timed.groupBy(key).transformWithState(Streaks(), f"{key} {kind}, {step} int, streak int", "append", "EventTime", initialState=start)
