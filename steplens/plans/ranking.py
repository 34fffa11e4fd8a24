"""Evaluation of ranking models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from steplens.operators import joins, profile, resampling, rows
from steplens.operators import ranking as R
from steplens.plans.joins import DRAWS, DRAWS_SQL
from steplens.plans.profiles import rounded
from steplens.plans.registry import query
from steplens.plans.windows import counts
from steplens.sources.tables import Tables


def curve_sql(by: str, source: str = "tx", score: str = "score", where: str = "y is not null", n: str = "count(*)", pos: str = "sum(y)") -> str:
    k = by + ", " if by else ""
    part = f"partition by {by}" if by else ""
    return f"""h as (select {k}{score} s, {n} n, {pos} pos from {source} where {where} group by {k}{score}),
    cu as (select {k}s, n, pos, sum(pos) over ({part} order by s desc) tp, sum(n) over ({part} order by s desc) alerts, sum(pos) over ({part}) p, sum(n) over ({part}) total, sum(n - pos) over ({part} order by s) - (n - pos) below from h)"""


def by_sql(by: str) -> str:
    return f"group by {by}" if by else ""


AP = "sum(case when p > 0 then pos / p * tp / alerts end)"
AUC = "case when max(p) = 0 or max(p) = max(total) then 0.5 else sum(pos * (2 * below + n - pos)) / (2 * max(p) * (max(total) - max(p))) end"
_CONF = "count(*) filter (where y = 1 and score >= {0}) tp, count(*) filter (where y = 0 and score >= {0}) fp, count(*) filter (where y = 0 and score < {0}) tn, count(*) filter (where y = 1 and score < {0}) fn"
_RATES = "round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 6) as precision, round(case when tp + fn > 0 then tp / (tp + fn) else 0 end, 6) recall, round(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end, 6) f1"
_PRF = ["precision", "recall", "f1"]


@query("confusion", f"with c as (select step, {_CONF.format(0.435)} from tx where y is not null group by 1) select step, tp, fp, tn, fn, {_RATES} from c")
def confusion(t: Tables) -> DataFrame:
    return rounded(R.confusion(t.tx, ["step"]), _PRF)


@query("average_precision", f"with {curve_sql('step')} select step, max(total)::bigint n, max(p)::bigint pos, round({AP}, 6) ap from cu group by step")
def average_precision(t: Tables) -> DataFrame:
    return rounded(R.average_precision(t.tx, ["step"]), ["ap"])


@query("pr_auc_trapezoid", f"""with {curve_sql('step')}, c as (select step, s, p, total, case when p > 0 then tp / p else 0 end r, tp / alerts q from cu), a as (select step, p, total, (r - coalesce(lag(r) over w, 0)) * (q + coalesce(lag(q) over w, 1)) / 2 area from c window w as (partition by step order by s desc))
    select step, round(case when max(p) = 0 or max(p) = max(total) then 0 else sum(area) end, 6) pr_auc from a group by 1""")
def pr_auc_trapezoid(t: Tables) -> DataFrame:
    return rounded(R.pr_auc_trapezoid(t.tx, ["step"]), ["pr_auc"])


@query("roc_auc", f"with {curve_sql('step')} select step, round({AUC}, 6) auc from cu group by step")
def roc_auc(t: Tables) -> DataFrame:
    return rounded(R.roc_auc(t.tx, ["step"]), ["auc"])


@query("metrics_by_group", f"""with w as (select "window" g, y, score from tx join windows on step between lo and hi), {curve_sql('g', 'w')}, m as (select g, max(total)::bigint n, max(p)::bigint pos, round({AP}, 6) ap, round({AUC}, 6) auc from cu group by g),
    c as (select g, {_CONF.format(0.435)} from w where y is not null group by 1)
    select g, tp, fp, tn, fn, {_RATES}, n, pos, ap, auc, case when pos = 0 then 'no positive rows' when pos = n then 'no negative rows' end reason from c join m using (g)""")
def metrics_by_group(t: Tables) -> DataFrame:
    w = rows.window_mask(t.tx.select("step", "y", "score"), t.windows()).withColumnRenamed("window", "g")
    return rounded(R.metrics_by_group(w, ["g"]), [*_PRF, "ap", "auc"])


_GRID = "gd as (select unnest(range(197)) i), gr as (select round(0.01 + 0.005 * i, 3)::double tau from gd)"
_F1T = "2 * tp / (2 * tp + fp + fn)"


def tau_sql(by: str, source: str) -> str:
    return f"""{_GRID}, tc as (select {by}, tau, count(*) filter (where y = 1 and score >= tau) tp, count(*) filter (where y = 0 and score >= tau) fp, count(*) filter (where y = 1 and score < tau) fn, min(y) <> max(y) two from {source}, gr where y is not null group by {by}, tau),
    bt as (select {by}, case when two then tau else 0.5 end tau, case when two then {_F1T} else 0 end f1 from tc qualify row_number() over (partition by {by} order by case when 2 * tp + fp + fn > 0 then {_F1T} else 0 end desc, tau) = 1)"""


@query("f1_threshold", f"with {tau_sql('step', '(select * from tx where step >= 25)')} select step, tau, round(f1, 6) f1 from bt")
def f1_threshold(t: Tables) -> DataFrame:
    return rounded(R.f1_threshold(t.tx.where("step >= 25"), ["step"]), ["f1"])


@query("oracle_f1", f"with {curve_sql('step')} select step, round(max(2 * tp / (alerts + p)), 6) oracle_f1 from cu group by step")
def oracle_f1(t: Tables) -> DataFrame:
    return rounded(R.oracle_f1(t.tx, ["step"]), ["oracle_f1"])


_SHIFT = "case when {1} > 0 and {1} < 1 and {2} > 0 and {2} < 1 then greatest(0.01, least(0.99, ({0} / (1 - {0}) * ({1} / (1 - {1})) / ({2} / (1 - {2}))) / (1 + {0} / (1 - {0}) * ({1} / (1 - {1})) / ({2} / (1 - {2}))))) else {0} end"


@query("prior_shift_threshold", f"with c as (select step, sum(y) / count(y) p from tx group by 1) select step, round({_SHIFT.format('0.435', '0.10', 'p')}, 6) tau from c")
def prior_shift_threshold(t: Tables) -> DataFrame:
    c = counts(t).withColumn("p", F.col("positive") / F.col("labelled"))
    return c.select("step", F.round(R.prior_shift(F.lit(0.435), F.lit(0.10), F.col("p")), 6).alias("tau"))


def trailing_histogram(t: Tables, width: int | None) -> DataFrame:
    """(t, score, n, pos): labelled rows a decision at t may read, of the last ``width`` steps or of all."""
    h = joins.score_histogram(t.tx, "score", "y", ["step"])
    spine = t.spine(35).select(F.col("step").alias("t"))
    rule = F.col("step") <= F.col("t") - 1 if width is None else F.col("step").between(F.col("t") - width, F.col("t") - 1)
    return h.join(F.broadcast(spine), rule).groupBy("t", "score").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))


def adaptive(t: Tables, width: int | None) -> DataFrame:
    h = trailing_histogram(t, width)
    prior = h.groupBy("t").agg((F.sum("pos") / F.sum("n")).alias("p"))
    taus = R.best_tau(h, ["t"]).select("t", F.col("tau").alias("rolling_tau"))
    return taus.join(prior, "t").select(F.col("t").alias("step"), "rolling_tau", F.round(R.prior_shift(F.lit(0.435), F.lit(0.10), F.col("p")), 6).alias("prior_tau"))


def adaptive_sql(low: str) -> str:
    pool = f"pool as (select s.step t, y, score from spine s join tx x on x.step between {low} and s.step - 1 where s.step >= 35 and y is not null)"
    return f"{pool}, {tau_sql('t', 'pool')}, pv as (select t, sum(y) / count(*) p from pool group by t), ad as (select bt.t step, tau rolling_tau, round({_SHIFT.format('0.435', '0.10', 'p')}, 6) prior_tau from bt join pv using (t))"


@query("adaptive_threshold", f"with {adaptive_sql('s.step - 5')} select * from ad")
def adaptive_threshold(t: Tables) -> DataFrame:
    return adaptive(t, 5)


@query("adaptive_pool", f"with {adaptive_sql('1')} select * from ad")
def adaptive_pool(t: Tables) -> DataFrame:
    return adaptive(t, None)


_CMP = {"frozen": "0.435", "rolling": "rolling_tau", "prior": "prior_tau", "oracle": "otau"}


@query("threshold_compare", f"""with {adaptive_sql('s.step - 5')}, og as (select step, tau, count(*) filter (where y = 1 and score >= tau) tp, count(*) filter (where y = 0 and score >= tau) fp, count(*) filter (where y = 1 and score < tau) fn, min(y) <> max(y) two from tx, gr where y is not null and step >= 35 group by step, tau),
    ot as (select step, case when two then tau else 0.435 end otau from og qualify row_number() over (partition by step order by case when 2 * tp + fp + fn > 0 then {_F1T} else 0 end desc, tau) = 1),
    f as (select x.step, max(otau) otau, {", ".join(f"count(*) filter (where y = 1 and score >= {c}) tp_{n}, count(*) filter (where y = 0 and score >= {c}) fp_{n}, count(*) filter (where y = 1 and score < {c}) fn_{n}" for n, c in _CMP.items())} from tx x join ad using (step) join ot using (step) where y is not null group by x.step),
    r as (select step, otau, {", ".join(f"case when 2 * tp_{n} + fp_{n} + fn_{n} > 0 then 2 * tp_{n} / (2 * tp_{n} + fp_{n} + fn_{n}) else 0 end f1_{n}" for n in _CMP)} from f)
    select step, otau tau_oracle, {", ".join(f"round(f1_{n}, 6) f1_{n}" for n in _CMP)}, {", ".join(f"round(f1_{n} - f1_frozen, 6) lift_{n}" for n in list(_CMP)[1:])} from r""")
def threshold_compare(t: Tables) -> DataFrame:
    taus = adaptive(t, 5).select("step", F.lit(0.435).alias("tau_frozen"), F.col("rolling_tau").alias("tau_rolling"), F.col("prior_tau").alias("tau_prior"))
    found = R.threshold_compare(t.tx.where("step >= 35"), taus, ["frozen", "rolling", "prior"])
    return rounded(found, [c for c in found.columns if c.startswith(("f1_", "lift_"))])


def topk_sql(ks: tuple[int, ...] = (20, 50, 100)) -> str:
    return f"""rk as (select step, y, row_number() over (partition by step order by score desc, tx_id) r from tx where y is not null and step >= 35), tt as (select step, count(*) n, sum(y) pos from rk group by 1),
    tk as (select step, k, sum(y)::bigint hits, count(*) alerts from rk, (values {", ".join(f"({k})" for k in ks)}) v(k) where r <= k group by 1, 2), tb as (select step, k, hits, alerts, n, pos::bigint pos from tk join tt using (step))"""


@query("topk_budget", f"""with {topk_sql()} select step, k, hits, alerts, n, pos, round(hits / alerts, 6) as precision, round(case when pos > 0 then hits / pos else 0 end, 6) recall, round(case when pos > 0 then hits / alerts / (pos / n) else 0 end, 6) lift,
    round(case when pos > 0 then least(k, pos) / pos else 0 end, 6) recall_ceiling, round(least(k, pos) / alerts, 6) precision_ceiling from tb""")
def topk_budget(t: Tables) -> DataFrame:
    return rounded(R.topk_budget(t.tx.where("step >= 35"), [20, 50, 100], ["step"]), ["precision", "recall", "lift", "recall_ceiling", "precision_ceiling"])


@query("topk_window", f'with {topk_sql()} select "window", k, sum(hits)::bigint hits, round(sum(hits) / sum(alerts), 6) as precision, round(sum(hits) / sum(pos), 6) recall from tb join windows on step between lo and hi group by 1, 2')
def topk_window(t: Tables) -> DataFrame:
    b = rows.window_mask(R.topk_budget(t.tx.where("step >= 35"), [20, 50, 100], ["step"]), t.windows())
    return b.groupBy("window", "k").agg(F.sum("hits").alias("hits"), F.round(F.sum("hits") / F.sum("alerts"), 6).alias("precision"), F.round(F.sum("hits") / F.sum("pos"), 6).alias("recall"))


@query("topk_ceiling", f'with {topk_sql()} select "window", k, round(sum(least(k, pos)) / sum(pos), 6) recall_ceiling from tb join windows on step between lo and hi group by 1, 2')
def topk_ceiling(t: Tables) -> DataFrame:
    pos = counts(t).where("step >= 35").select("step", F.col("positive").alias("pos")).withColumn("k", F.explode(F.array(F.lit(20), F.lit(50), F.lit(100))))
    return rows.window_mask(pos, t.windows()).groupBy("window", "k").agg(F.round(F.sum(F.least("k", "pos")) / F.sum("pos"), 6).alias("recall_ceiling"))


@query("operating_rules", f"""with {topk_sql((50,))}, th as (select step, count(*) filter (where score >= 0.7) alerts, count(*) filter (where score >= 0.7 and y = 1) hits, sum(y) pos from tx where y is not null and step >= 35 group by 1),
    al as (select 'threshold' rule, step, hits, alerts, pos from th union all select 'top50', step, hits, alerts, pos from tb)
    select "window", rule, sum(hits)::bigint hits, sum(alerts)::bigint alerts, count(*) filter (where alerts = 0) zero_alert_steps, round(case when sum(alerts) > 0 then sum(hits) / sum(alerts) else 0 end, 6) as precision, round(sum(hits) / sum(pos), 6) recall from al join windows on step between lo and hi group by 1, 2""")
def operating_rules(t: Tables) -> DataFrame:
    late = t.tx.where("step >= 35 AND y IS NOT NULL")
    a = late.groupBy("step").agg(F.lit("threshold").alias("rule"), F.count_if(F.expr("score >= 0.7 AND y = 1")).alias("hits"), F.count_if(F.expr("score >= 0.7")).alias("alerts"), F.sum("y").alias("pos"))
    b = R.topk_budget(late, [50], ["step"]).select("step", F.lit("top50").alias("rule"), "hits", "alerts", "pos")
    w = rows.window_mask(a.unionByName(b), t.windows()).groupBy("window", "rule")
    return w.agg(F.sum("hits").alias("hits"), F.sum("alerts").alias("alerts"), F.count_if(F.col("alerts") == 0).alias("zero_alert_steps"), F.round(R.ratio(F.sum("hits"), F.sum("alerts")), 6).alias("precision"), F.round(F.sum("hits") / F.sum("pos"), 6).alias("recall"))


def _boot(alt: bool = False) -> str:
    score = "case when tx_id % 3 = 0 then score else score / 2 end" if alt else "score"
    return f"(select draw, {score} sc, y, weight from tx join ({DRAWS_SQL}) using (step) where y is not null)"


def draws(t: Tables, alt: bool = False) -> DataFrame:
    score = "CASE WHEN tx_id % 3 = 0 THEN score ELSE score / CAST(2 AS DOUBLE) END" if alt else "score"
    late = t.tx.where("step >= 35").select("step", "y", F.expr(score).alias("score"))
    h = joins.score_histogram(late, "score", "y", ["step"])
    return R.draw_metrics(R.weighted_histogram(h, joins.draw_weights(t.spark, DRAWS, list(range(35, 50)))), source=h)


_F1D = "2 * sum(case when s >= 0.435 then pos else 0 end) / (sum(case when s >= 0.435 then n else 0 end) + max(p))"
_DRAW = f"select draw, {AP} ap, {AUC} auc, {_F1D} f1 from cu group by draw"


def quantiles_sql(values: tuple[str, ...]) -> str:
    return ", ".join(f"round(quantile_cont({v}, {p}), 6) {v}_{n}" for v in values for p, n in ((0.025, "low"), (0.5, "middle"), (0.975, "high")))


def rounded_intervals(df: DataFrame) -> DataFrame:
    return rounded(df, [c for c in df.columns if c.endswith(("_low", "_middle", "_high"))])


@query("cluster_bootstrap", f"with {curve_sql('draw', _boot(), 'sc', 'true', 'sum(weight)', 'sum(weight * y)')}, d as ({_DRAW}) select count(*) draws, {quantiles_sql(('ap', 'auc', 'f1'))} from d")
def cluster_bootstrap(t: Tables) -> DataFrame:
    return rounded_intervals(R.intervals(draws(t), ["ap", "auc", "f1"]))


#: Draws of single rows: each is as large as the table.
_ROW_DRAWS = 200
_ROWS = f"""lb as (select step, score, y, row_number() over (partition by step order by score desc, y desc) - 1 place, count(*) over (partition by step) total from tx where y is not null and step >= 35),
    pk as (select step, draw, {joins.drawn("draw", "(slot * 64 + step)", 2)} % total place from (select distinct step, total from lb), (select unnest(range({_ROW_DRAWS})) draw), lateral (select unnest(range(total)) slot)),
    rw as (select draw, score sc, y, count(*) weight from pk join lb using (step, place) group by 1, 2, 3)"""


@query("row_bootstrap")
def row_bootstrap(t: Tables) -> DataFrame:
    """Intervals over 1,000 draws of as many rows of each step as it has; numpy draws, so no SQL repeats it."""
    h = joins.score_histogram(t.tx.where("step >= 35"), "score", "y", ["step"])
    return rounded_intervals(R.intervals(R.draw_metrics(resampling.row_draws(h, DRAWS), source=h), ["ap", "auc", "f1"]))


@query("row_bootstrap_picks", f"with {_ROWS}, {curve_sql('draw', 'rw', 'sc', 'true', 'sum(weight)', 'sum(weight * y)')}, d as ({_DRAW}) select count(*) draws, {quantiles_sql(('ap', 'auc', 'f1'))} from d")
def row_bootstrap_picks(t: Tables) -> DataFrame:
    """The same of fewer draws that pick row by row, in whole numbers that SQL repeats."""
    h = joins.score_histogram(t.tx.where("step >= 35"), "score", "y", ["step"])
    return rounded_intervals(R.intervals(R.draw_metrics(joins.row_draws(h, _ROW_DRAWS), source=h), ["ap", "auc", "f1"]))


@query("paired_delta", f"""with {curve_sql('draw', _boot(), 'sc', 'true', 'sum(weight)', 'sum(weight * y)')}, d1 as (select draw, {AP} a from cu group by draw),
    {curve_sql('draw', _boot(True), 'sc', 'true', 'sum(weight)', 'sum(weight * y)').replace('h as', 'h2 as', 1).replace('cu as', 'cu2 as').replace('from h)', 'from h2)')}, d2 as (select draw, {AP} b from cu2 group by draw), d as (select a - b delta from d1 join d2 using (draw))
    select count(*) draws, {quantiles_sql(('delta',))}, quantile_cont(delta, 0.025) > 0 or quantile_cont(delta, 0.975) < 0 excludes_zero from d""")
def paired_delta(t: Tables) -> DataFrame:
    return rounded_intervals(R.paired_delta(draws(t), draws(t, True)))


@query("sustained_recovery", f"""with {curve_sql('step')}, a as (select step, max(p) pos, {AP} ap from cu group by step), e as (select step, ap >= 0.15 and coalesce(lead(ap) over (order by step), -1) >= 0.15 and coalesce(lead(ap, 2) over (order by step), -1) >= 0.15 ok from a where step >= 35 and pos >= 10)
    select min(step) filter (where ok) recovered_at from e""")
def sustained_recovery(t: Tables) -> DataFrame:
    return R.sustained_recovery(R.average_precision(t.tx.where("step >= 35"), ["step"]), 0.15, min_pos=10)


@query("tail_curve", f"with w as (select s.step s0, y, score from spine s join tx x on x.step >= s.step where s.step >= 43 and y is not null), {curve_sql('s0', 'w')} select s0, max(p)::bigint pos, round({AP}, 6) ap from cu group by s0")
def tail_curve(t: Tables) -> DataFrame:
    h = joins.score_histogram(t.tx.where("step >= 43"), "score", "y", ["step"])
    starts = t.spine(43).select(F.col("step").alias("s0"))
    pooled = h.join(F.broadcast(starts), F.col("step") >= F.col("s0")).groupBy("s0", "score").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    return rounded(R.ap_of(R.cumulative_curve(pooled, ["s0"]), ["s0"]), ["ap"]).select("s0", "pos", "ap")


@query("f1_ceiling", f"with {curve_sql('step')}, o as (select step, max(p) pos, max(2 * tp / (alerts + p)) best from cu group by step), c as (select step, {_CONF.format(0.435)} from tx where y is not null group by 1), f as (select step, case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end f1 from c) select round(sum(pos * f1) / sum(pos), 6) f1, round(sum(pos * best) / sum(pos), 6) ceiling from o join f using (step) where step >= 35")
def f1_ceiling(t: Tables) -> DataFrame:
    late = t.tx.where("step >= 35")
    j = R.oracle_f1(late, ["step"]).join(R.confusion(late, ["step"]), "step").withColumn("pos", F.expr("tp + fn"))
    return j.agg(F.round(F.sum(F.expr("pos * f1")) / F.sum("pos"), 6).alias("f1"), F.round(F.sum(F.expr("pos * oracle_f1")) / F.sum("pos"), 6).alias("ceiling"))


@query("threshold_instability", f"with {adaptive_sql('s.step - 5')} select min(rolling_tau) least, max(rolling_tau) greatest, round(max(rolling_tau) - min(rolling_tau), 6) as range, round(stddev_pop(rolling_tau), 6) std, count(distinct rolling_tau) distinct_taus from ad")
def threshold_instability(t: Tables) -> DataFrame:
    return adaptive(t, 5).agg(F.min("rolling_tau").alias("least"), F.max("rolling_tau").alias("greatest"), F.round(F.max("rolling_tau") - F.min("rolling_tau"), 6).alias("range"), F.round(F.stddev_pop("rolling_tau"), 6).alias("std"), F.countDistinct("rolling_tau").alias("distinct_taus"))


@query("metric_association", f"""with {curve_sql('step')}, a as (select step, round({AP}, 9) ap from cu group by step), b as (select step, round(avg(score), 9) m from tx group by 1), r as (select rank() over (order by ap) + (count(*) over (partition by ap) - 1) / 2 x, rank() over (order by m) + (count(*) over (partition by m) - 1) / 2 y from a join b using (step) where step >= 35 and ap is not null) select round(corr(x, y), 6) rho from r""")
def metric_association(t: Tables) -> DataFrame:
    a = R.average_precision(t.tx, ["step"]).select("step", F.round("ap", 9).alias("ap"))
    b = t.tx.groupBy("step").agg(F.round(F.avg("score"), 9).alias("m"))
    j = a.join(b, "step").where("step >= 35 AND ap IS NOT NULL").withColumn("g", F.lit(1))
    return profile.spearman(j, "ap", "m", ["g"]).select(F.round("rho", 6).alias("rho"))


@query("error_types", """select step, case when y = 1 and score < 0.435 then 'FN' when y = 0 and score >= 0.435 then 'FP' else 'correct' end kind, count(*) n, count(*) filter (where price >= 150000) in_group, round(quantile_cont(score, 0.5), 6) median_score from tx where y is not null and step >= 35 group by 1, 2""")
def error_types(t: Tables) -> DataFrame:
    return rounded(R.error_types(t.tx.where("step >= 35"), F.col("price") >= 150000), ["median_score"])


@query("baseline_rows", 'select "window", count(y) n, round(sum(y) / count(y), 6) constant_ap, 0.5::double constant_auc, 0.0::double flag_nothing_f1, round(2 * (sum(y) / count(y)) / (1 + sum(y) / count(y)), 6) flag_all_f1 from tx join windows on step between lo and hi group by 1')
def baseline_rows(t: Tables) -> DataFrame:
    p = F.sum("y") / F.count("y")
    return rows.window_mask(t.tx.select("step", "y"), t.windows()).groupBy("window").agg(F.count("y").alias("n"), F.round(p, 6).alias("constant_ap"), F.lit(0.5).alias("constant_auc"), F.lit(0.0).alias("flag_nothing_f1"), F.round(2 * p / (1 + p), 6).alias("flag_all_f1"))


@query("model_pivot", f"""with w as (select m model, "window" g, y, case when m = 'half' then case when tx_id % 2 = 0 then score else 0 end else score end score from tx join windows on step between lo and hi, (values ('full'), ('half')) v(m)), {curve_sql('model, g', 'w')}, a as (select model, g, {AP} ap from cu group by model, g)
    select model, {", ".join(f"round(max(ap) filter (where g = '{g}'), 6) {g}" for g in ("train", "early", "drift"))} from a group by model""")
def model_pivot(t: Tables) -> DataFrame:
    w = rows.window_mask(t.tx.select("tx_id", "step", "y", "score"), t.windows()).withColumn("model", F.explode(F.array(F.lit("full"), F.lit("half"))))
    w = w.withColumn("score", F.expr("CASE WHEN model = 'half' THEN CASE WHEN tx_id % 2 = 0 THEN score ELSE CAST(0 AS DOUBLE) END ELSE score END"))
    p = R.average_precision(w, ["model", "window"]).groupBy("model").pivot("window", ["train", "early", "drift"]).agg(F.max("ap"))
    return rounded(p, ["train", "early", "drift"])


@query("score_quadrants", """with q as (select tx_id, case when y = 1 and score >= 0.435 then 'TP' when y = 0 and score >= 0.435 then 'FP' when y = 1 then 'FN' else 'TN' end quadrant from tx where y is not null and step >= 35)
    select tx_id, quadrant from q qualify row_number() over (partition by quadrant order by (tx_id * 7919) % 104729, tx_id) <= 100""")
def score_quadrants(t: Tables) -> DataFrame:
    q = F.expr("CASE WHEN y = 1 AND score >= 0.435D THEN 'TP' WHEN y = 0 AND score >= 0.435D THEN 'FP' WHEN y = 1 THEN 'FN' ELSE 'TN' END")
    own = t.tx.where("y IS NOT NULL AND step >= 35").select("tx_id", q.alias("quadrant"))
    w = Window.partitionBy("quadrant").orderBy(F.expr("(tx_id * 7919) % 104729"), "tx_id")
    return own.withColumn("_n", F.row_number().over(w)).where("_n <= 100").select("tx_id", "quadrant")
