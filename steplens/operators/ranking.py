"""Evaluation of scored rows: confusion, curves, thresholds, top-K, bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steplens.operators.joins import grid_bin, score_histogram
from steplens.operators.prefix import quantiles, running_by_value, value_edges


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b != 0, a.cast("double") / b).otherwise(0.0)


def confusion(df: DataFrame, by: list[str] | None = None, score: str = "score", y: str = "y", tau: float | str = 0.435) -> DataFrame:
    """tp, fp, tn, fn, precision, recall, f1 over labelled rows; what is undefined is 0."""
    hit = F.col(score) >= (F.col(tau) if isinstance(tau, str) else tau)
    p, n = F.col(y) == 1, F.col(y) == 0
    counts = df.where(F.col(y).isNotNull()).groupBy(*(by or [])).agg(F.count_if(p & hit).alias("tp"), F.count_if(n & hit).alias("fp"), F.count_if(n & ~hit).alias("tn"), F.count_if(p & ~hit).alias("fn"))
    return rates(counts)


def rates(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn)).withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn))


def cumulative_curve(histogram: DataFrame, by: list[str] | None = None, edges: DataFrame | None = None) -> DataFrame:
    """tp and alerts at each distinct score from the highest down, with the totals. Score ranges of a group are summed apart and
    carried, so that no window holds more than a range."""
    by = by or []
    curve = running_by_value(histogram.select(*by, "score", "n", "pos"), by, "score", ["pos", "n"], descending=True, edges=edges)
    return curve.select(*by, "score", "n", "pos", F.col("run_pos").alias("tp"), F.col("run_n").alias("alerts"), F.col("all_pos").alias("p"), F.col("all_n").alias("total"))


def average_precision(df: DataFrame, by: list[str] | None = None, score: str = "score", y: str = "y") -> DataFrame:
    """Sum over distinct scores of the gain in recall times precision; null without positives."""
    return ap_of(cumulative_curve(score_histogram(df, score, y, by), by), by)


def ap_of(curve: DataFrame, by: list[str] | None = None) -> DataFrame:
    gain = F.col("pos") / F.col("p") * F.col("tp") / F.col("alerts")
    return curve.groupBy(*(by or [])).agg(F.max("total").alias("n"), F.max("p").alias("pos"), F.sum(F.when(F.col("p") > 0, gain)).alias("ap"))


def ap_auc_of(curve: DataFrame, by: list[str] | None = None) -> DataFrame:
    """AP and AUC from one curve; AUC is 0.5 with one class only, and its counts stay whole numbers."""
    p, q = F.max("p"), F.max("total") - F.max("p")
    gain, neg = F.col("pos") / F.col("p") * F.col("tp") / F.col("alerts"), F.col("n") - F.col("pos")
    below = (F.col("total") - F.col("alerts")) - (F.col("p") - F.col("tp"))  # negatives of lower scores
    auc = F.when((p == 0) | (q == 0), 0.5).otherwise(F.sum(F.col("pos") * (2 * below + neg)).cast("double") / (2.0 * p * q))
    return curve.groupBy(*(by or [])).agg(F.max("total").alias("n"), p.alias("pos"), F.sum(F.when(F.col("p") > 0, gain)).alias("ap"), auc.alias("auc"))


def pr_auc_trapezoid(df: DataFrame, by: list[str] | None = None, score: str = "score", y: str = "y") -> DataFrame:
    """Trapezoids under precision over recall from (0, 1) on; 0 with one class only."""
    by = by or []
    curve = cumulative_curve(score_histogram(df, score, y, by), by)
    before, seen = F.col("tp") - F.col("pos"), F.col("alerts") - F.col("n")
    precision = F.when(seen > 0, before / seen).otherwise(F.lit(1.0))
    area = (ratio(F.col("tp"), F.col("p")) - ratio(before, F.col("p"))) * (F.col("tp") / F.col("alerts") + precision) / 2
    one = (F.max("p") == 0) | (F.max("p") == F.max("total"))
    return curve.withColumn("area", area).groupBy(*by).agg(F.when(one, 0.0).otherwise(F.sum("area")).alias("pr_auc"))


def roc_auc(df: DataFrame, by: list[str] | None = None, score: str = "score", y: str = "y") -> DataFrame:
    """The share of positive-negative pairs in order, ties half; 0.5 with one class only. Counts stay whole numbers."""
    return auc_of(score_histogram(df, score, y, by), by)


def auc_of(histogram: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or []
    counts = histogram.select(*by, "score", "pos", (F.col("n") - F.col("pos")).alias("neg"))
    below = running_by_value(counts, by, "score", ["neg"]).withColumn("below", F.col("run_neg") - F.col("neg"))
    sums = below.groupBy(*by).agg(F.sum(F.col("pos") * (2 * F.col("below") + F.col("neg"))).alias("twice"), F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    return sums.select(*by, F.when((F.col("p") == 0) | (F.col("q") == 0), 0.5).otherwise(F.col("twice").cast("double") / (2.0 * F.col("p") * F.col("q"))).alias("auc"))


def metrics_by_group(df: DataFrame, by: list[str], score: str = "score", y: str = "y", tau: float = 0.435) -> DataFrame:
    """All metrics of each group from one histogram, and why AP is undefined where it is."""
    h = score_histogram(df, score, y, by)
    ap = ap_of(cumulative_curve(h, by), by)
    hit = F.col("score") >= tau
    neg = F.col("n") - F.col("pos")
    counts = h.groupBy(*by).agg(F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, neg).otherwise(0)).alias("fp"), F.sum(F.when(~hit, neg).otherwise(0)).alias("tn"), F.sum(F.when(~hit, F.col("pos")).otherwise(0)).alias("fn"))
    out = rates(counts).join(ap, by).join(auc_of(h, by), by)
    reason = F.when(F.col("pos") == 0, "no positive rows").when(F.col("pos") == F.col("n"), "no negative rows")
    return out.withColumn("reason", reason)


GRID = [round(0.01 + 0.005 * i, 3) for i in range(197)]


def f1_threshold(df: DataFrame, by: list[str] | None = None, grid: list[float] = GRID, fallback: float = 0.5, score: str = "score", y: str = "y") -> DataFrame:
    """The least tau of the grid with the highest F1; the fallback with one class only."""
    by = by or []
    return best_tau(score_histogram(df, score, y, by), by, grid, fallback)


def best_tau(histogram: DataFrame, by: list[str], grid: list[float] = GRID, fallback: float = 0.5) -> DataFrame:
    """The same from a histogram (by, score, n, pos). Scores fall into the bins of the grid once, and the counts of the bins
    are summed from the top: between two bins that hold scores every tau counts alike, so only the least one is tried."""
    taus = F.array(*[F.lit(float(t)) for t in grid])
    bins = histogram.groupBy(*by, grid_bin(grid).alias("_bin")).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    above = Window.partitionBy(*by).orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole, order = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("_bin")
    tp, alerts, p = F.sum("pos").over(above), F.sum("n").over(above), F.sum("pos").over(whole)
    tried = bins.select(*by, "n", "pos", "_bin", tp.alias("tp"), (alerts - tp).alias("fp"), (p - tp).alias("fn"), F.get(taus, F.coalesce(F.lag("_bin").over(order), F.lit(0))).alias("tau"))
    real = F.col("_bin") > 0
    best = rates(tried).groupBy(*by).agg(F.max_by(F.struct("tau", "f1"), F.when(real, F.struct("f1", -F.col("tau")))).alias("best"), ((F.sum("pos") == 0) | (F.sum("pos") == F.sum("n"))).alias("one"))
    return best.select(*by, F.when(F.col("one"), fallback).otherwise(F.coalesce("best.tau", F.lit(grid[0]))).alias("tau"), F.when(F.col("one"), 0.0).otherwise(F.coalesce("best.f1", F.lit(0.0))).alias("f1"))


def oracle_f1(df: DataFrame, by: list[str] | None = None, score: str = "score", y: str = "y") -> DataFrame:
    """The highest F1 over all score cuts."""
    by = by or []
    curve = cumulative_curve(score_histogram(df, score, y, by), by)
    return curve.groupBy(*by).agg(F.max(ratio(2 * F.col("tp"), F.col("alerts") + F.col("p"))).alias("oracle_f1"))


def prior_shift(tau: Column, old: Column, new: Column, low: float = 0.01, high: float = 0.99) -> Column:
    """``tau`` moved by the ratio of the odds of two prevalences, clipped."""
    odds = tau / (1 - tau) * (old / (1 - old)) / (new / (1 - new))
    moved = F.greatest(F.lit(low), F.least(F.lit(high), odds / (1 + odds)))
    return F.when((new > 0) & (new < 1) & (old > 0) & (old < 1), moved).otherwise(tau)


def topk(df: DataFrame, k: int, by: list[str], score: str = "score", key: str = "tx_id") -> DataFrame:
    """The ``k`` rows of each group with the highest scores, ties to the smaller key."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), key)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def topk_budget(df: DataFrame, ks: list[int], by: list[str], score: str = "score", y: str = "y", key: str = "tx_id") -> DataFrame:
    """Precision and recall of alert budgets for each group, their lift and their ceilings."""
    known = df.where(F.col(y).isNotNull())
    top = topk(known.select(*by, key, score, y), max(ks), by, score, key).select(*by, "rank", y, F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).where("rank <= k")
    hits = top.groupBy(*by, "k").agg(F.sum(y).alias("hits"), F.count("*").alias("alerts"))
    totals = known.groupBy(*by).agg(F.count("*").alias("n"), F.sum(y).alias("pos"))
    out = hits.join(totals, by)
    out = out.withColumn("precision", ratio(F.col("hits"), F.col("alerts"))).withColumn("recall", ratio(F.col("hits"), F.col("pos")))
    out = out.withColumn("lift", ratio(F.col("precision"), F.col("pos") / F.col("n")))
    return out.withColumn("recall_ceiling", ratio(F.least("k", "pos"), F.col("pos"))).withColumn("precision_ceiling", ratio(F.least("k", "pos"), F.col("alerts")))


def weighted_histogram(by_step: DataFrame, weights: DataFrame, draw: str = "draw", step: str = "step") -> DataFrame:
    """(draw, score, n, pos) of draws of whole steps: step histograms times whole weights, never rows repeated."""
    return by_step.join(weights, step).groupBy(draw, "score").agg(F.sum(F.expr("weight * n")).alias("n"), F.sum(F.expr("weight * pos")).alias("pos"))


def draw_metrics(h: DataFrame, tau: float = 0.435, draw: str = "draw", source: DataFrame | None = None) -> DataFrame:
    """AP, AUC and F1 at a threshold of each draw's histogram: one pass over a curve. ``source`` is the histogram that was drawn from;
    its score ranges serve all draws."""
    edges = None if source is None else value_edges(source, [], "score")
    curve = cumulative_curve(h, [draw], edges).withColumn("_neg", F.col("n") - F.col("pos"))
    below = (F.col("total") - F.col("alerts")) - (F.col("p") - F.col("tp"))  # negatives of lower scores
    gain = F.when(F.col("p") > 0, F.col("pos") / F.col("p") * F.col("tp") / F.col("alerts"))
    hit = F.col("score") >= tau
    sums = curve.groupBy(draw).agg(
        F.sum(gain).alias("ap"), F.sum(F.col("pos") * (2 * below + F.col("_neg"))).alias("_twice"), F.max("p").alias("_p"), F.max("total").alias("_n"),
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("_tp"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("_alerts"),
    )
    auc = F.when((F.col("_p") == 0) | (F.col("_p") == F.col("_n")), 0.5).otherwise(F.col("_twice").cast("double") / (2.0 * F.col("_p") * (F.col("_n") - F.col("_p"))))
    return sums.select(draw, "ap", auc.alias("auc"), ratio(2 * F.col("_tp"), F.col("_alerts") + F.col("_p")).alias("f1"))


def intervals(df: DataFrame, values: list[str], low: float = 0.025, high: float = 0.975) -> DataFrame:
    """One row of the number of draws and the ``low``, middle and ``high`` quantile of each value; a draw is one row of ``df``."""
    cells = [F.expr(f"percentile({v}, {p})").alias(f"{v}_{n}") for v in values for p, n in ((low, "low"), (0.5, "middle"), (high, "high"))]
    return df.agg(F.count("*").alias("draws"), *cells)


def paired_delta(a: DataFrame, b: DataFrame, value: str = "ap", draw: str = "draw") -> DataFrame:
    """The interval of the difference of two models over the same draws, and whether it leaves zero out."""
    d = a.select(draw, F.col(value).alias("a")).join(b.select(draw, F.col(value).alias("b")), draw).select((F.col("a") - F.col("b")).alias("delta"))
    out = intervals(d, ["delta"])
    return out.withColumn("excludes_zero", (F.col("delta_low") > 0) | (F.col("delta_high") < 0))


def threshold_compare(scored: DataFrame, taus: DataFrame, names: list[str], score: str = "score", y: str = "y", step: str = "step", oracle_fallback: float = 0.435) -> DataFrame:
    """F1 of each step under each named threshold of ``taus`` (step, tau_name), and under the oracle's, which reads the step's
    own labels and is a bound, not a rule; and what each gains over the first name. One pass over the score histogram."""
    h = score_histogram(scored, score, y, [step])
    oracle = best_tau(h, [step], fallback=oracle_fallback).select(step, F.col("tau").alias("tau_oracle"))
    every = [*names, "oracle"]
    joined = h.join(F.broadcast(taus), step).join(F.broadcast(oracle), step)  # one row a step
    sums = [F.sum(F.when(F.col("score") >= F.col(f"tau_{n}"), F.col(c)).otherwise(0)).alias(f"_{c}_{n}") for n in every for c in ("n", "pos")]
    out = joined.groupBy(step).agg(F.sum("pos").alias("_p"), F.max("tau_oracle").alias("tau_oracle"), *sums)
    f1 = {n: ratio(2 * F.col(f"_pos_{n}"), F.col(f"_n_{n}") + F.col("_p")) for n in every}
    return out.select(step, "tau_oracle", *[f1[n].alias(f"f1_{n}") for n in every], *[(f1[n] - f1[names[0]]).alias(f"lift_{n}") for n in every[1:]])


def sustained_recovery(ap: DataFrame, floor: float = 0.5, hold: int = 2, value: str = "ap", step: str = "step", min_pos: int = 0) -> DataFrame:
    """The first eligible step whose value reaches the floor and holds it for the next ``hold`` eligible steps."""
    w = Window.orderBy(step)
    ok = F.col(value) >= floor
    for i in range(1, hold + 1):
        ok = ok & (F.coalesce(F.lead(value, i).over(w), F.lit(-1.0)) >= floor)
    eligible = ap.where(F.col(value).isNotNull() & (F.col("pos") >= min_pos)) if min_pos else ap.where(F.col(value).isNotNull())
    return eligible.withColumn("ok", ok).agg(F.min(F.when(F.col("ok"), F.col(step))).alias("recovered_at"))


def error_types(df: DataFrame, group: Column, tau: float = 0.435, score: str = "score", y: str = "y", step: str = "step") -> DataFrame:
    """(step, kind, n, in_group, median_score): labelled rows that were missed, flagged wrongly or judged right, how many of
    them are of a subgroup, and their median score."""
    kind = F.when((F.col(y) == 1) & (F.col(score) < tau), "FN").when((F.col(y) == 0) & (F.col(score) >= tau), "FP").otherwise("correct")
    known = df.where(F.col(y).isNotNull()).withColumn("kind", kind)
    counts = known.groupBy(step, "kind").agg(F.count("*").alias("n"), F.count_if(group).alias("in_group"))
    medians = quantiles(known.where(F.col(score).isNotNull()), [step, "kind"], score, [0.5], "q")
    return counts.join(medians, [step, "kind"], "left").select(step, "kind", "n", "in_group", F.get("q", F.lit(0)).alias("median_score"))
