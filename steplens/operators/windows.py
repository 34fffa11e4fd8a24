"""Frames over steps: ranges, last eligible rows, lags, streaks, curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from steplens.operators.prefix import ranged
from steplens.sources.scratch import materialise


def rolling_prevalence(counts: DataFrame, lag: int, width: int, step: str = "step", pos: str = "positive", n: str = "labelled") -> DataFrame:
    """Positive over labelled rows of the steps in (t - lag - width, t - lag]: a range of step values, so gaps count."""
    w = Window.orderBy(step).rangeBetween(-(lag + width - 1), -lag)
    return counts.withColumn("rolling_positive", F.coalesce(F.sum(pos).over(w), F.lit(0))).withColumn("rolling_labelled", F.coalesce(F.sum(n).over(w), F.lit(0))).withColumn("rolling_prevalence", F.when(F.col("rolling_labelled") > 0, F.col("rolling_positive") / F.col("rolling_labelled")))


def last_n_eligible(decisions: DataFrame, steps: DataFrame, n: int, lag: int, step: str = "step") -> DataFrame:
    """(t, step, recency): for each decision step t the last ``n`` recorded steps up to t - lag; a row count, not a range.
    Both sides are per-step tables."""
    s = steps.select(F.col(step))
    pairs = decisions.select(F.col(step).alias("t")).join(F.broadcast(s), F.col(step) <= F.col("t") - lag)
    w = Window.partitionBy("t").orderBy(F.desc(step))
    return pairs.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= n)


def lag_k(df: DataFrame, key: str, order: list[str], value: str, ks: list[int]) -> DataFrame:
    """The k-th previous value of the key for each k. Rows are cut into ranges of the order of key and ``order``, and the last rows
    before a range come along with it, so a key of very many rows is spread over all ranges."""
    far = max(ks)
    written = ranged(df, F.col(key).asc_nulls_first(), *[F.col(c) for c in order], name="lags")
    spans = written.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    spans = materialise(spans.select("_range", "_n", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_start")), "lag-ranges")  # one row a range
    s = F.broadcast(spans)
    tails = written.join(s, "_range").where(F.col("_row") >= F.col("_n") - far).withColumn("_at", F.col("_start") + F.col("_row"))
    later = F.broadcast(spans.select(F.col("_range").alias("_r"), F.col("_start").alias("_s")))
    ghosts = tails.join(later, (F.col("_s") > F.col("_at")) & (F.col("_s") <= F.col("_at") + far))
    ghosts = ghosts.select(*[F.col(c) for c in df.columns], F.col("_r").alias("_range"), (F.col("_at") - F.col("_s")).alias("_row"))
    w = Window.partitionBy("_range", key).orderBy("_row")
    both = written.select(*df.columns, "_range", "_row").unionByName(ghosts)
    return both.withColumns({f"{value}_lag{k}": F.lag(value, k).over(w) for k in ks}).where("_row >= 0").drop("_range", "_row")


def step_delta(per_step: DataFrame, values: list[str], step: str = "step", by: list[str] | None = None) -> DataFrame:
    w = Window.partitionBy(*(by or [])).orderBy(step)
    return per_step.withColumns({f"delta_{v}": F.col(v) - F.lag(v).over(w) for v in values})


def trailing_pool(per_step: DataFrame, targets: DataFrame, width: int, step: str = "step") -> DataFrame:
    """Rows of a per-step table once for each target step t with step in [t - width, t - 1]."""
    t = targets.select(F.col(step).alias("t"))
    return per_step.join(F.broadcast(t), F.col(step).between(F.col("t") - width, F.col("t") - 1))


def streak(per_step: DataFrame, hit: str, step: str = "step") -> DataFrame:
    """Consecutive hits up to each step, 0 on a miss: a miss starts a new island."""
    w = Window.orderBy(step)
    island = F.sum(F.when(F.col(hit), 0).otherwise(1)).over(w)
    marked = per_step.withColumn("_island", island)
    inside = Window.partitionBy("_island").orderBy(step)
    return marked.withColumn("streak", F.sum(F.when(F.col(hit), 1).otherwise(0)).over(inside)).drop("_island")


def cumulative_counts(per_step: DataFrame, values: list[str], step: str = "step") -> DataFrame:
    w = Window.orderBy(step).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per_step.withColumns({f"cumulative_{v}": F.sum(v).over(w) for v in values})


def lorenz(df: DataFrame, value: str, key: str) -> DataFrame:
    """Cumulative share of a short table's values from the largest down."""
    w = Window.orderBy(F.desc(value), key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(value), key))).withColumn("share", F.sum(value).over(w) / F.sum(value).over(Window.partitionBy()))
