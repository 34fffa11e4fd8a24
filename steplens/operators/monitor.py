"""Monitoring in which a decision at step t reads labels of steps up to t - lag only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steplens.operators import drift, ranking
from steplens.operators.prefix import running_by_value
from steplens.operators.rows import finite
from steplens.operators.windows import last_n_eligible, rolling_prevalence, streak

#: Statuses that count as an alert, and those that say nothing.
ALERTS = ("MODERATE", "WARNING", "ALERT", "CRITICAL", "SIGNIFICANT")
SILENT = ("", "UNAVAILABLE", "NOT_EVALUATED")


def label_guard(uses: DataFrame, lag: int, label_step: str = "label_step", at: str = "t") -> DataFrame:
    """Uses of labels that had not arrived: a label of step s is usable from s + lag on."""
    return uses.where(F.col(label_step) + lag > F.col(at))


def assert_label_arrival(uses: DataFrame, lag: int, label_step: str = "label_step", at: str = "t") -> DataFrame:
    """``uses``; the job fails on the first row that reads a label before its arrival."""
    ok = F.assert_true(F.col(label_step) + lag <= F.col(at), F.lit("a label was used before its arrival"))
    return uses.where(ok.isNull())


def eligible_steps(decisions: DataFrame, steps: DataFrame, lag: int, step: str = "step") -> DataFrame:
    """(t, step): recorded steps that a decision at t may read; both tables are per-step."""
    return decisions.select(F.col(step).alias("t")).join(F.broadcast(steps.select(step)), F.col(step) <= F.col("t") - lag)


def f1_floor(validation_f1: float, fraction: float = 0.5) -> float:
    if not 0 < fraction <= 1 or not 0 < validation_f1 <= 1:
        raise ValueError("the fraction and the validation F1 must be in (0, 1]")
    return fraction * validation_f1


def performance_channel(scored: DataFrame, decisions: DataFrame, floor: float, lag: int = 1, last: int = 2, least_positives: int = 10, tau: float = 0.435, step: str = "step") -> DataFrame:
    """The worst per-step F1 of the last eligible steps with enough positives; a breach if it is below the floor."""
    return performance_of(ranking.confusion(scored, [step], tau=tau), decisions, floor, lag, last, least_positives, step)


def performance_of(per_step: DataFrame, decisions: DataFrame, floor: float, lag: int = 1, last: int = 2, least_positives: int = 10, step: str = "step") -> DataFrame:
    """The same from confusion counts of steps (step, tp, fn, f1)."""
    f1 = per_step.where(F.col("tp") + F.col("fn") >= least_positives).select(step, "f1")
    used = last_n_eligible(decisions, f1, last, lag, step).join(f1, step)
    worst = used.groupBy(F.col("t").alias(step)).agg(F.min("f1").alias("f1_min"), F.max(used[step]).alias("newest_label_step"), F.count("*").alias("steps_used"))
    out = decisions.select(step).join(worst, step, "left").fillna(0, ["steps_used"])
    status = F.when(F.col("f1_min").isNull(), "UNAVAILABLE").when(F.col("f1_min") < floor, "CRITICAL").otherwise("OK")
    return out.withColumn("performance_status", status)


def prevalence_channel(counts: DataFrame, baseline: float, lag: int = 1, width: int = 5, collapse: float = 0.035, warn: float = 0.30, alert: float = 0.60, step: str = "step") -> DataFrame:
    """Rolling prevalence of arrived labels against a baseline; the collapse test comes first, and without eligible steps
    the baseline stands in."""
    found = rolling_prevalence(counts, lag, width, step)
    w = Window.orderBy(step).rangeBetween(-(lag + width - 1), -lag)
    known = found.withColumn("_steps", F.count("labelled").over(w)).withColumn("rolling", F.when(F.col("_steps") == 0, F.lit(baseline)).otherwise(F.col("rolling_positive") / F.greatest(F.col("rolling_labelled"), F.lit(1))))
    change = (F.col("rolling") - baseline) / baseline
    level = F.when(F.col("_steps") == 0, "STABLE").when(F.col("rolling") <= collapse, "ALERT").when(F.abs(change) >= alert, "ALERT").when(F.abs(change) >= warn, "WARNING").otherwise("STABLE")
    return known.select(step, F.col("rolling").alias("rolling_prevalence"), change.alias("relative_change"), (F.col("rolling") - baseline).alias("absolute_change"), level.alias("prevalence_level"))


def score_shift_channel(scored: DataFrame, decisions: DataFrame, edges: list[float], last: int = 5, lag: int = 1, floor: float = 1e-4, least: int = 2, step: str = "step", y: str = "y") -> DataFrame:
    """PSI of a step's scores against the mean of the bin shares of its last arrived labelled steps, their labelled rows alone
    and each step weighing the same. With fewer than ``least`` such steps, or no scores, the channel is UNAVAILABLE."""
    counts = scored.where(finite("score")).groupBy(step, drift.score_bin(edges).alias("bin")).agg(F.count("*").alias("n"), F.count(y).alias("labelled"))
    return score_shift_of(counts, decisions, len(edges) + 1, last, lag, floor, least, step)


def score_shift_of(counts: DataFrame, decisions: DataFrame, bins: int, last: int = 5, lag: int = 1, floor: float = 1e-4, least: int = 2, step: str = "step") -> DataFrame:
    """The same from counts of rows and of labelled rows (step, bin, n, labelled)."""
    per = Window.partitionBy(step)
    shares = counts.withColumn("p", F.col("n") / F.sum("n").over(per)).withColumn("all_labelled", F.sum("labelled").over(per))
    known = shares.where("all_labelled > 0").withColumn("q", F.col("labelled") / F.col("all_labelled"))
    used = last_n_eligible(decisions, known.select(step).distinct(), last, lag, step)
    size = used.groupBy("t").agg(F.count("*").alias("k")).where(F.col("k") >= least)
    size = size.join(shares.select(F.col(step).alias("t")).distinct(), "t")
    q = used.join(known.select(step, "bin", "q"), step).groupBy("t", "bin").agg(F.sum("q").alias("s")).join(size, "t").select("t", "bin", (F.col("s") / F.col("k")).alias("q"))
    grid = size.select("t", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    full = grid.join(q, ["t", "bin"], "left").join(shares.select(F.col(step).alias("t"), "bin", "p"), ["t", "bin"], "left")
    w = Window.partitionBy("t")
    for c in ("p", "q"):
        full = full.withColumn(c, F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(floor)))
        full = full.withColumn(c, F.col(c) / F.sum(c).over(w))
    psi = full.groupBy(F.col("t").alias(step)).agg(F.sum((F.col("p") - F.col("q")) * F.ln(F.col("p") / F.col("q"))).alias("psi"))
    status = F.when(F.col("psi").isNull(), "UNAVAILABLE").when(F.col("psi") >= drift.SIGNIFICANT, "CRITICAL").when(F.col("psi") >= drift.MODERATE, "WARNING").otherwise("OK")
    return decisions.select(step).join(psi, step, "left").withColumn("status", status)


def _pool(per_step: DataFrame, scored: DataFrame, decisions: DataFrame, last: int, lag: int, step: str) -> DataFrame:
    used = last_n_eligible(decisions, scored.select(step).distinct(), last, lag, step)
    return used.join(per_step, step)


def score_ks_channel(scored: DataFrame, decisions: DataFrame, last: int = 5, lag: int = 1, cut: float = 0.10, step: str = "step") -> DataFrame:
    """KS of a step's scores against the pooled scores of its last eligible steps."""
    h = scored.groupBy(step, F.col("score").alias("value")).agg(F.count("*").alias("n"))
    past = _pool(h, scored, decisions, last, lag, step).select("t", "value", F.col("n").alias("a"), F.lit(0).cast("long").alias("b"))
    own = h.join(F.broadcast(decisions.select(step)), step).select(F.col(step).alias("t"), "value", F.lit(0).cast("long").alias("a"), F.col("n").alias("b"))
    both = past.unionByName(own).groupBy("t", "value").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    gaps = running_by_value(both, ["t"], "value", ["a", "b"]).withColumn("gap", F.abs(F.col("run_a") / F.col("all_a") - F.col("run_b") / F.col("all_b")))
    return gaps.groupBy(F.col("t").alias(step)).agg(F.max("gap").alias("ks")).withColumn("alert", F.col("ks") >= cut)


def positive_rate_channel(scored: DataFrame, decisions: DataFrame, last: int = 5, lag: int = 1, tau: float = 0.435, low: float = 0.5, high: float = 2.0, step: str = "step") -> DataFrame:
    """Rate of flagged rows against that of the pooled last eligible steps."""
    per = scored.groupBy(step).agg(F.count("*").alias("n"), F.count_if(F.col("score") >= tau).alias("hits"))
    past = _pool(per, scored, decisions, last, lag, step).groupBy(F.col("t").alias(step)).agg((F.sum("hits") / F.sum("n")).alias("pool"))
    out = past.join(per, step).withColumn("ratio", F.when(F.col("pool") > 0, F.col("hits") / F.col("n") / F.col("pool")))
    return out.select(step, "ratio", F.coalesce((F.col("ratio") < low) | (F.col("ratio") > high), F.lit(False)).alias("alert"))


def cadence(spine: DataFrame, every: int = 5, always: tuple[int, ...] = (35, 49), step: str = "step") -> DataFrame:
    return spine.where((F.col(step) % every == 0) | F.col(step).isin(*always))


#: The names of the reasons of a decision, in the order in which they are given.
_RETRAIN = ("ConcentratedMacroDrift", "ScoreShift", "PerformanceCrash", "PrevalenceRegimeCollapse")
_RECALIBRATE = ("FeatureDriftWarning", "DiffuseMicroDriftWarning", "ScoreShiftWarning", "PrevalenceAlert", "PrevalenceWarning", "AdversarialOODAlert")


def trigger_decision(channels: DataFrame, floor: float, step: str = "step") -> DataFrame:
    """One decision a step from its channel columns: triad_extreme, triad_significant (counts), triad_level, local_percent,
    score_psi, f1_min, rolling_prevalence, prevalence_level, domain_auc; nulls are channels that were not evaluated.

    Any retrain reason makes it RETRAIN, else any recalibrate reason RECALIBRATE_ONLY. One focal feature in the
    significant band alone raises nothing.
    """
    extreme, significant, psi = F.col("triad_extreme"), F.col("triad_significant"), F.col("score_psi")
    collapse = F.col("rolling_prevalence") <= 0.035
    hits = {
        "ConcentratedMacroDrift": (extreme >= 1) | (significant >= 2),
        "ScoreShift": psi >= drift.SIGNIFICANT,
        "PerformanceCrash": F.col("f1_min") < floor,
        "PrevalenceRegimeCollapse": collapse,
        "FeatureDriftWarning": ~F.coalesce((extreme >= 1) | (significant >= 2), F.lit(False)) & (F.col("triad_level") == "MODERATE"),
        "DiffuseMicroDriftWarning": F.col("local_percent") >= 30,
        "ScoreShiftWarning": (psi >= drift.MODERATE) & (psi < drift.SIGNIFICANT),
        "PrevalenceAlert": ~collapse & (F.col("prevalence_level") == "ALERT"),
        "PrevalenceWarning": ~collapse & (F.col("prevalence_level") == "WARNING"),
        "AdversarialOODAlert": F.col("domain_auc") >= 0.85,
    }
    of = lambda names: F.array_compact(F.array(*[F.when(F.coalesce(hits[n], F.lit(False)), F.lit(n)) for n in names]))
    out = channels.withColumn("retrain", of(_RETRAIN)).withColumn("recalibrate", of(_RECALIBRATE))
    out = out.withColumn("reasons", F.concat("retrain", "recalibrate"))
    action = F.when(F.size("retrain") > 0, "RETRAIN").when(F.size("recalibrate") > 0, "RECALIBRATE_ONLY").otherwise("NO_ACTION")
    severity = F.when(F.size("retrain") > 0, "CRITICAL").when(F.size("recalibrate") > 0, "WARNING").otherwise("INFO")
    return out.withColumn("action", action).withColumn("severity", severity).withColumn("primary_reason", F.coalesce(F.get("reasons", F.lit(0)), F.lit("Stable"))).drop("retrain", "recalibrate")


def _status(null: Column, critical: Column, warning: Column) -> Column:
    return F.when(null, "NOT_EVALUATED").when(critical, "CRITICAL").when(warning, "WARNING").otherwise("OK")


def channel_breakdown(decisions: DataFrame, floor: float, step: str = "step") -> DataFrame:
    """(step, channel, kind, status, value, threshold, can_trigger_critical) for each channel of a decision table."""
    c = F.col
    level = c("prevalence_level")
    rows = [
        ("triad", "label_free", _status(c("triad_extreme").isNull(), (c("triad_extreme") >= 1) | (c("triad_significant") >= 2), c("triad_level") == "MODERATE"), c("triad_max"), 0.25, True),
        ("feature_shift", "label_free", _status(c("local_percent").isNull(), F.lit(False), c("local_percent") >= 30), c("local_percent"), 30.0, False),
        ("score_shift", "label_free", _status(c("score_psi").isNull(), c("score_psi") >= 0.25, c("score_psi") >= 0.10), c("score_psi"), 0.25, True),
        ("performance", "label_dependent", _status(c("f1_min").isNull(), c("f1_min") < floor, F.lit(False)), c("f1_min"), floor, True),
        ("prevalence", "label_dependent", _status(c("rolling_prevalence").isNull(), c("rolling_prevalence") <= 0.035, level.isin("ALERT", "WARNING")), c("rolling_prevalence"), 0.035, True),
        ("adversarial", "label_free", _status(c("domain_auc").isNull(), F.lit(False), c("domain_auc") >= 0.85), c("domain_auc"), 0.85, False),
    ]
    cells = [F.struct(F.lit(n).alias("channel"), F.lit(k).alias("kind"), s.alias("status"), v.cast("double").alias("value"), F.lit(float(h)).alias("threshold"), F.lit(t).alias("can_trigger_critical")) for n, k, s, v, h, t in rows]
    return decisions.select(step, F.explode(F.array(*cells)).alias("c")).select(step, "c.*")


def signal_eval(long: DataFrame, early: tuple[int, int] = (35, 42), late: tuple[int, int] = (43, 49), step: str = "step") -> DataFrame:
    """Per signal (signal, step, status): steps evaluated, alerts, false-alarm rate in the early window, first alert in the
    late one and its lead. Blank and unavailable states are not evaluated."""
    s = F.upper(F.trim(F.coalesce("status", F.lit(""))))
    on, hit = ~s.isin(*SILENT), s.isin(*ALERTS)
    a, b = F.col(step).between(*early), F.col(step).between(*late)
    out = long.groupBy("signal").agg(
        F.count_if(on & a).alias("n_early"), F.count_if(on & hit & a).alias("alerts_early"), F.count_if(on & b).alias("n_late"), F.count_if(on & hit & b).alias("alerts_late"), F.min(F.when(on & hit & b, F.col(step))).alias("first_alert"),
    )
    out = out.withColumn("false_alarm_rate", F.when(F.col("n_early") > 0, F.col("alerts_early") / F.col("n_early")))
    return out.withColumn("lead", F.col("first_alert") - late[0]).withColumn("detected", F.col("first_alert").isNotNull())


def first_critical(breakdown: DataFrame, step: str = "step") -> DataFrame:
    return breakdown.groupBy("channel").agg(F.min(F.when(F.col("status") == "CRITICAL", F.col(step))).alias("first_critical"))


def concordance(a: DataFrame, b: DataFrame, windows: DataFrame, value: str = "action", step: str = "step") -> DataFrame:
    """Share of steps on which two decision sequences agree, per window."""
    j = a.select(step, F.col(value).alias("x")).join(b.select(step, F.col(value).alias("y")), step)
    w = F.broadcast(windows)
    return j.join(w, F.col(step).between(w["lo"], w["hi"])).groupBy("window").agg(F.count("*").alias("n"), F.count_if(F.expr("x <=> y")).alias("agree"), F.count_if(F.expr("x <=> y AND x <> 'NO_ACTION'")).alias("agree_active"))


def window_means(per_step: DataFrame, windows: DataFrame, values: list[str], step: str = "step") -> DataFrame:
    w = F.broadcast(windows)
    return per_step.join(w, F.col(step).between(w["lo"], w["hi"])).groupBy("window").agg(*[F.avg(v).alias(f"mean_{v}") for v in values])


def floor_robustness(worst: DataFrame, validation_f1: float, early: tuple[int, int] = (35, 42), late: tuple[int, int] = (43, 49), step: str = "step") -> DataFrame:
    """The interval of floor fractions that separates the windows alike: above the least late F1, at most the least early."""
    return worst.agg((F.min(F.when(F.col(step).between(*late), F.col("f1_min"))) / validation_f1).alias("low"), (F.min(F.when(F.col(step).between(*early), F.col("f1_min"))) / validation_f1).alias("high"))


def local_streak(report: DataFrame, percent: str = "local_percent", cut: float = 30.0, step: str = "step") -> DataFrame:
    """``report`` with streak: for how many steps on end the share of drifted features has been at the cut or above."""
    return streak(report.withColumn("_hit", F.coalesce(F.col(percent) >= cut, F.lit(False))), "_hit", step).drop("_hit")
