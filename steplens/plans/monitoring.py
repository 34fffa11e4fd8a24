"""Label-delay-safe monitoring; ``monitoring_table`` is the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steplens.operators import discriminant, drift, ranking
from steplens.operators import monitor as M
from steplens.plans.drifts import _SCORES, _U, _X, BINS, JUDGED_SQL, SCORE_PSI_SQL, domain_sql, judged, scores
from steplens.plans.profiles import rounded
from steplens.plans.registry import query
from steplens.plans.windows import COUNTS_SQL, counts
from steplens.sources.scratch import small
from steplens.sources.tables import Tables

#: Half of the F1 that the frozen threshold has on the views' validation window, to two digits.
FLOOR = 0.31
BASELINE = 0.10


@query("label_guard", "select count(*) violations from tx a join (select distinct step t from tx) on t between step and step + 1 where y is not null and step + 1 > t")
def label_guard(t: Tables) -> DataFrame:
    uses = t.tx.where("y IS NOT NULL").select(F.col("step").alias("label_step"), F.explode(F.array(F.col("step"), F.col("step") + 1)).alias("t"))
    known = t.tx.select(F.col("step").alias("t")).distinct()
    return M.label_guard(uses.join(known, "t"), 1).agg(F.count("*").alias("violations"))


@query("eligible_steps", "select t.step t, s.step from spine t join (select distinct step from tx) s on s.step <= t.step - 2 where t.step >= 35")
def eligible_steps(t: Tables) -> DataFrame:
    return M.eligible_steps(t.spine(35), t.tx.select("step").distinct(), 2)


_F1 = """f1 as (select step, case when 2 * tp + fp + fn > 0 then 2.0::double * tp / (2 * tp + fp + fn) else 0 end f1, tp + fn pos from
    (select step, count(*) filter (where y = 1 and score >= 0.435) tp, count(*) filter (where y = 0 and score >= 0.435) fp, count(*) filter (where y = 1 and score < 0.435) fn from tx where y is not null group by step))"""
_PERF = f"""{_F1}, pu as (select t.step t, f.step, f1 from spine t join f1 f on f.pos >= 10 and f.step <= t.step - 1 where t.step >= 35 qualify row_number() over (partition by t.step order by f.step desc) <= 2),
    perf as (select s.step, min(f1) f1_min, max(u.step) newest_label_step, count(u.step) steps_used, case when min(f1) is null then 'UNAVAILABLE' when min(f1) < {FLOOR} then 'CRITICAL' else 'OK' end performance_status from spine s left join pu u on u.t = s.step where s.step >= 35 group by s.step)"""


def performance(t: Tables) -> DataFrame:
    return M.performance_channel(t.tx, t.spine(35), FLOOR)


@query("performance_channel", f"with {_PERF} select step, round(f1_min, 6) f1_min, newest_label_step, steps_used, performance_status from perf")
def performance_channel(t: Tables) -> DataFrame:
    return rounded(performance(t), ["f1_min"])


@query("f1_floor", f"with {_F1} select round(0.5 * max(f1), 6) floor from f1 where step between 25 and 34")
def f1_floor(t: Tables) -> DataFrame:
    f1 = ranking.confusion(t.tx.where("step BETWEEN 25 AND 34"), ["step"])
    return f1.agg(F.round(0.5 * F.max("f1"), 6).alias("floor"))


_PREV = f"""pc as ({COUNTS_SQL}), pr as (select a.step, case when count(b.step) = 0 then {BASELINE} else coalesce(sum(b.positive), 0) / greatest(coalesce(sum(b.labelled), 0), 1) end rolling_prevalence, count(b.step) k from pc a left join pc b on b.step between a.step - 5 and a.step - 1 group by a.step),
    prev as (select step, rolling_prevalence, (rolling_prevalence - {BASELINE}) / {BASELINE} relative_change, rolling_prevalence - {BASELINE} absolute_change, case when k = 0 then 'STABLE' when rolling_prevalence <= 0.035 then 'ALERT'
      when abs((rolling_prevalence - {BASELINE}) / {BASELINE}) >= 0.6 then 'ALERT' when abs((rolling_prevalence - {BASELINE}) / {BASELINE}) >= 0.3 then 'WARNING' else 'STABLE' end prevalence_level from pr)"""


def prevalence(t: Tables) -> DataFrame:
    return M.prevalence_channel(counts(t), BASELINE)


@query("prevalence_channel", f"with {_PREV} select step, round(rolling_prevalence, 6) rolling_prevalence, round(relative_change, 6) relative_change, round(absolute_change, 6) absolute_change, prevalence_level from prev")
def prevalence_channel(t: Tables) -> DataFrame:
    return rounded(prevalence(t), ["rolling_prevalence", "relative_change", "absolute_change"])


def channels(t: Tables) -> DataFrame:
    """Every channel column of steps 35 to 49. The transactions are read once, for counts by step, score bin, side of the
    threshold and label; the vectors for edges, cells, and the domain classifiers' moments and scores. All that follows works on
    tables of steps."""
    hit = F.col("score") >= 0.435
    cells = small(t.tx.groupBy("step", drift.score_bin(BINS).alias("bin"), hit.alias("hit"), "y").agg(F.count("*").alias("n")), "tx-cells")
    spine = small(t.spine(1), "spine")
    late = spine.where("step >= 35")
    of = lambda c: F.coalesce(F.sum(F.when(F.expr(c), F.col("n"))), F.lit(0))
    f1 = ranking.rates(cells.groupBy("step").agg(of("y = 1 AND hit").alias("tp"), of("y = 0 AND hit").alias("fp"), of("y = 0 AND NOT hit").alias("tn"), of("y = 1 AND NOT hit").alias("fn")).where("tp + fp + tn + fn > 0"))
    per = cells.groupBy("step").agg(F.sum("n").alias("total"), of("y IS NOT NULL").alias("labelled"), of("y = 1").alias("positive"))
    bins = cells.groupBy("step", "bin").agg(F.sum("n").alias("n"), of("y IS NOT NULL").alias("labelled"))
    focal = F.col("feature").isin("f_mono", "f0")
    s = scores(t).groupBy("step").agg(
        F.count_if(focal & (F.col("drift_score") >= 1.0)).alias("triad_extreme"), F.count_if(focal & (F.col("drift_score") >= 0.25)).alias("triad_significant"), F.max(F.when(focal, F.col("drift_score"))).alias("triad_max"),
        (100.0 * F.count_if(~focal & (F.col("level") == "SIGNIFICANT")) / F.count_if(~focal)).alias("local_percent"),
    )
    s = s.withColumn("triad_level", F.when(F.col("triad_max") > 0.25, "SIGNIFICANT").when(F.col("triad_max") >= 0.10, "MODERATE").otherwise("STABLE"))
    auc = small(discriminant.domain_auc(t.vec, _X, judged(t), 34, "vec_id"), "domain-auc").select("step", "domain_auc")
    psi = M.score_shift_of(bins, late, len(BINS) + 1).select("step", F.col("psi").alias("score_psi"))
    prev = M.prevalence_channel(spine.join(per, "step", "left").fillna(0), BASELINE).select("step", "rolling_prevalence", "prevalence_level")
    out = late
    for channel in (s, psi, M.performance_of(f1, late, FLOOR).select("step", "f1_min", "newest_label_step"), prev, auc):
        out = out.join(channel.hint("merge"), "step", "left")  # one partition each: no exchange and no broadcast
    return M.local_streak(out).withColumnRenamed("streak", "local_streak")


_CH = f"""{_U}, {_SCORES}, {SCORE_PSI_SQL}, {_PERF}, {_PREV}, {JUDGED_SQL}, {domain_sql("dm", _X)},
    tri as (select step, count(*) filter (where feature in ('f_mono', 'f0') and v >= 1.0) triad_extreme, count(*) filter (where feature in ('f_mono', 'f0') and v >= 0.25) triad_significant, max(v) filter (where feature in ('f_mono', 'f0')) triad_max,
      100.0 * count(*) filter (where feature not in ('f_mono', 'f0') and level = 'SIGNIFICANT') / count(*) filter (where feature not in ('f_mono', 'f0')) local_percent from lv group by 1),
    ch0 as (select s.step, triad_extreme, triad_significant, triad_max, local_percent, case when triad_max > 0.25 then 'SIGNIFICANT' when triad_max >= 0.10 then 'MODERATE' else 'STABLE' end triad_level, psi score_psi, f1_min, newest_label_step, rolling_prevalence, prevalence_level, domain_auc,
      coalesce(local_percent >= 30, false) lh from spine s left join tri using (step) left join score_psi using (step) left join perf using (step) left join prev using (step) left join dm using (step) where s.step >= 35),
    ch1 as (select *, sum(case when lh then 0 else 1 end) over (order by step) isl from ch0), ch as (select *, sum(case when lh then 1 else 0 end) over (partition by isl order by step)::bigint local_streak from ch1)"""
DECISION_SQL = f"""{_CH}, hit as (select *, coalesce(triad_extreme >= 1 or triad_significant >= 2, false) h1, coalesce(score_psi >= 0.25, false) h2, coalesce(f1_min < {FLOOR}, false) h3, coalesce(rolling_prevalence <= 0.035, false) h4, coalesce(local_percent >= 30, false) r2, coalesce(domain_auc >= 0.85, false) r6,
      coalesce(score_psi >= 0.10 and score_psi < 0.25, false) r3 from ch),
    rs as (select *, [x for x in [case when h1 then 'ConcentratedMacroDrift' end, case when h2 then 'ScoreShift' end, case when h3 then 'PerformanceCrash' end, case when h4 then 'PrevalenceRegimeCollapse' end] if x is not null] a,
      [x for x in [case when not h1 and triad_level = 'MODERATE' then 'FeatureDriftWarning' end, case when r2 then 'DiffuseMicroDriftWarning' end, case when r3 then 'ScoreShiftWarning' end, case when not h4 and prevalence_level = 'ALERT' then 'PrevalenceAlert' end, case when not h4 and prevalence_level = 'WARNING' then 'PrevalenceWarning' end, case when r6 then 'AdversarialOODAlert' end] if x is not null] b from hit),
    decision as (select *, a || b reasons, case when len(a) > 0 then 'RETRAIN' when len(b) > 0 then 'RECALIBRATE_ONLY' else 'NO_ACTION' end action, case when len(a) > 0 then 'CRITICAL' when len(b) > 0 then 'WARNING' else 'INFO' end severity from rs)"""


def decisions(t: Tables) -> DataFrame:
    return M.trigger_decision(channels(t), FLOOR)


@query("trigger_decision", f"with {DECISION_SQL} select step, action, severity, coalesce((a || b)[1], 'Stable') primary_reason, array_to_string(reasons, ',') reasons from decision")
def trigger_decision(t: Tables) -> DataFrame:
    return decisions(t).select("step", "action", "severity", "primary_reason", F.concat_ws(",", "reasons").alias("reasons"))


_ROUND = ["triad_max", "local_percent", "score_psi", "f1_min", "rolling_prevalence", "domain_auc"]


@query("monitoring_table", f"with {DECISION_SQL} select step, triad_extreme, triad_significant, triad_level, {', '.join(f'round({c}, 6) {c}' for c in _ROUND)}, local_streak, newest_label_step, prevalence_level, action, severity, array_to_string(reasons, ',') reasons from decision")
def monitoring_table(t: Tables) -> DataFrame:
    table = rounded(decisions(t), _ROUND)
    return table.select("step", "triad_extreme", "triad_significant", "triad_level", *_ROUND, "local_streak", "newest_label_step", "prevalence_level", "action", "severity", F.concat_ws(",", "reasons").alias("reasons"))


@query("latest_decision", f"with {DECISION_SQL} select step, action, severity from decision order by step desc limit 1")
def latest_decision(t: Tables) -> DataFrame:
    return decisions(t).agg(F.max_by(F.struct("step", "action", "severity"), "step").alias("d")).select("d.*")


_BRK = f"""{_CH}, brk as (
    select step, 'triad' channel, 'label_free' kind, case when triad_extreme is null then 'NOT_EVALUATED' when triad_extreme >= 1 or triad_significant >= 2 then 'CRITICAL' when triad_level = 'MODERATE' then 'WARNING' else 'OK' end status, triad_max::double as value, 0.25::double threshold, true can_trigger_critical from ch union all
    select step, 'feature_shift', 'label_free', case when local_percent is null then 'NOT_EVALUATED' when local_percent >= 30 then 'WARNING' else 'OK' end, local_percent, 30, false from ch union all
    select step, 'score_shift', 'label_free', case when score_psi is null then 'NOT_EVALUATED' when score_psi >= 0.25 then 'CRITICAL' when score_psi >= 0.10 then 'WARNING' else 'OK' end, score_psi, 0.25, true from ch union all
    select step, 'performance', 'label_dependent', case when f1_min is null then 'NOT_EVALUATED' when f1_min < {FLOOR} then 'CRITICAL' else 'OK' end, f1_min, {FLOOR}, true from ch union all
    select step, 'prevalence', 'label_dependent', case when rolling_prevalence is null then 'NOT_EVALUATED' when rolling_prevalence <= 0.035 then 'CRITICAL' when prevalence_level in ('ALERT', 'WARNING') then 'WARNING' else 'OK' end, rolling_prevalence, 0.035, true from ch union all
    select step, 'adversarial', 'label_free', case when domain_auc is null then 'NOT_EVALUATED' when domain_auc >= 0.85 then 'WARNING' else 'OK' end, domain_auc, 0.85, false from ch)"""


def breakdown(t: Tables) -> DataFrame:
    return M.channel_breakdown(decisions(t), FLOOR)


@query("channel_breakdown", f"with {_BRK} select step, channel, kind, status, round(value, 6) as value, threshold, can_trigger_critical from brk")
def channel_breakdown(t: Tables) -> DataFrame:
    return rounded(breakdown(t), ["value"])


@query("signal_eval", f"""with {_BRK}, s as (select channel signal, step, upper(status) in ('CRITICAL', 'WARNING') hit, status <> 'NOT_EVALUATED' ev from brk)
    select signal, count(*) filter (where ev and step <= 42) n_early, count(*) filter (where hit and step <= 42) alerts_early, count(*) filter (where ev and step >= 43) n_late, count(*) filter (where hit and step >= 43) alerts_late, min(step) filter (where hit and step >= 43) first_alert,
      round(case when count(*) filter (where ev and step <= 42) > 0 then count(*) filter (where hit and step <= 42) / count(*) filter (where ev and step <= 42) end, 6) false_alarm_rate, min(step) filter (where hit and step >= 43) - 43 lead, min(step) filter (where hit and step >= 43) is not null detected from s group by 1""")
def signal_eval(t: Tables) -> DataFrame:
    return rounded(M.signal_eval(breakdown(t).select(F.col("channel").alias("signal"), "step", "status")), ["false_alarm_rate"])


@query("first_critical", f"with {_BRK} select channel, min(step) filter (where status = 'CRITICAL') first_critical from brk group by 1")
def first_critical(t: Tables) -> DataFrame:
    return M.first_critical(breakdown(t))


@query("window_means", f'with {_F1} select "window", round(avg(f1), 6) mean_f1, round(avg(pos), 6) mean_pos from f1 join windows on step between lo and hi group by 1')
def window_means(t: Tables) -> DataFrame:
    f1 = ranking.confusion(t.tx, ["step"]).withColumn("pos", F.col("tp") + F.col("fn"))
    return rounded(M.window_means(f1, t.windows(), ["f1", "pos"]), ["mean_f1", "mean_pos"])


@query("floor_robustness", f"with {_PERF} select round(min(f1_min) filter (where step >= 43) / 0.62, 6) low, round(min(f1_min) filter (where step <= 42) / 0.62, 6) high from perf")
def floor_robustness(t: Tables) -> DataFrame:
    return rounded(M.floor_robustness(performance(t), 0.62), ["low", "high"])
