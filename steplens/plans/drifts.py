"""Drift statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steplens.operators import drift as D
from steplens.operators import discriminant, monitor, profile
from steplens.operators.joins import grid, permuted
from steplens.plans.profiles import rounded, sql_unpivot
from steplens.plans.registry import query
from steplens.sources.tables import Tables

_V = [*[f"f{i}" for i in range(8)], "f_mono"]
_U = f"u as ({sql_unpivot(_V, 'step, side, ')}), r as (select * from u where step <= 34), t as (select * from u where step >= 35)"
_PROBS = "[" + ", ".join(str(i / 10) for i in range(11)) + "]"


def long(t: Tables) -> DataFrame:
    return profile.unpivot(t.vec, ["step", "side"], _V)


def parts(t: Tables) -> tuple[DataFrame, DataFrame]:
    u = long(t).select("feature", "value", "step")
    return u.where("step <= 34"), u.where("step >= 35")


def psi_sql(by: str = "", floor: str = "1e-4", renorm: bool = True, closed: bool = False) -> str:
    k = by + ", " if by else ""
    keep = "where value between edges[1] and edges[-1]" if closed else ""
    norm = f"select {k}feature, q / sum(q) over (partition by {k}feature) q, p / sum(p) over (partition by {k}feature) p from z" if renorm else f"select {k}feature, q, p from z"
    return f"""e as (select feature, list_sort(list_distinct(quantile_cont(value, {_PROBS}))) edges from r group by 1), ei as (select feature, edges, edges[2:len(edges) - 1] mid from e),
    hq as (select feature, bin, count(*) / sum(count(*)) over (partition by feature) q from (select feature, len([x for x in mid if x <= value]) bin from r join ei using (feature) {keep}) group by 1, 2),
    hp as (select {k}feature, bin, count(*) / sum(count(*)) over (partition by {k}feature) p from (select {k}feature, len([x for x in mid if x <= value]) bin from t join ei using (feature) {keep}) group by {k}feature, bin),
    g as (select {k}feature, unnest(range(len(mid) + 1)) bin from (select distinct {k}feature from t) join ei using (feature)),
    z as (select {k}feature, greatest(coalesce(q, 0), {floor}) q, greatest(coalesce(p, 0), {floor}) p from g left join hq using (feature, bin) left join hp using ({k}feature, bin)),
    y as ({norm}), psi as (select {k}feature, sum((p - q) * ln(p / q)) psi from y group by {k}feature)"""


@query("psi", f"with {_U}, {psi_sql('step')} select step, feature, round(psi, 6) psi from psi")
def psi(t: Tables) -> DataFrame:
    r, q = parts(t)
    return rounded(D.psi(r, q, ["step"]), ["psi"])


@query("psi_train_window", f"with {_U}, {psi_sql('', '1e-6', False, True)} select feature, round(psi, 6) psi from psi")
def psi_train_window(t: Tables) -> DataFrame:
    r, q = parts(t)
    return rounded(D.psi(r, q, floor=1e-6, renormalise=False, ends="closed"), ["psi"])


@query("psi_interior", f"with {_U}, {psi_sql('', '1e-4', False)} select feature, round(psi, 6) psi from psi")
def psi_interior(t: Tables) -> DataFrame:
    r, q = parts(t)
    return rounded(D.psi(r, q, renormalise=False, ends="interior"), ["psi"])


def ks_sql(by: str = "", source: str = "select feature, value, cast(step >= 35 as int) s from u", name: str = "ks") -> str:
    k = by + ", " if by else ""
    return f"""{name}0 as ({source}), {name}1 as (select {k}feature, value, count(*) filter (where s = 0) a, count(*) filter (where s = 1) b from {name}0 group by {k}feature, value),
    {name}2 as (select {k}feature, abs(sum(a) over w / sum(a) over v - sum(b) over w / sum(b) over v) gap from {name}1 window w as (partition by {k}feature order by value), v as (partition by {k}feature)),
    {name} as (select {k}feature, max(gap) ks from {name}2 group by {k}feature)"""


@query("ks_two_sample", f"with {_U}, {ks_sql()} select feature, round(ks, 6) ks from ks")
def ks_two_sample(t: Tables) -> DataFrame:
    u = long(t).withColumn("s", (F.col("step") >= 35).cast("int"))
    return rounded(D.ks_two_sample(u, "s"), ["ks"]).select("feature", "ks")


@query("drift_ranking", f"""with {_U}, {psi_sql()}, {ks_sql()}, m as (select feature, avg(value) filter (where step <= 34) a, avg(value) filter (where step >= 35) b from u group by 1)
    select feature, round(ks, 6) ks, round(psi, 6) psi, round(a, 6) mean_reference, round(b, 6) mean_target, row_number() over (order by round(ks, 9) desc, feature) as rank from ks join psi using (feature) join m using (feature)""")
def drift_ranking(t: Tables) -> DataFrame:
    r, q = parts(t)
    return rounded(D.drift_ranking(r, q), ["ks", "psi", "mean_reference", "mean_target"])


@query("within_class_ks", f"with {_U}, {ks_sql('side', 'select feature, value, side, cast(step >= 35 as int) s from u')} select side, feature, round(ks, 6) ks from ks")
def within_class_ks(t: Tables) -> DataFrame:
    u = long(t).withColumn("s", (F.col("step") >= 35).cast("int"))
    return rounded(D.ks_two_sample(u, "s", ["side"]), ["ks"]).select("side", "feature", "ks")


_MED = "med as (select feature, step, quantile_cont(value, 0.5) median from r group by 1, 2)"
_MONO = """rk as (select feature, rank() over (partition by feature order by round(median, 9)) + (count(*) over (partition by feature, round(median, 9)) - 1) / 2 a, rank() over (partition by feature order by step) b, median from med),
    mono as (select feature, corr(a, b) rho, count(*) steps, count(distinct median) distinct_medians, coalesce(abs(corr(a, b)) >= 0.99 and count(*) >= 10 and count(distinct median) > 1, false) monotone from rk group by 1)"""


@query("monotone_detect", f"with {_U}, {_MED}, {_MONO} select feature, round(rho, 6) rho, steps, distinct_medians, monotone from mono")
def monotone_detect(t: Tables) -> DataFrame:
    return rounded(D.monotone_detect(D.step_medians(parts(t)[0])), ["rho"])


_FIT = """ff as (select feature, regr_slope(median, step) slope, regr_intercept(median, step) intercept, regr_slope(case when median > 0 then ln(median) end, step) log_slope, regr_intercept(case when median > 0 then ln(median) end, step) log_intercept, bool_and(median > 0) positive from med group by 1),
    er as (select feature, sqrt(avg((median - intercept - slope * step) ** 2)) linear_rmse, sqrt(avg((median - exp(log_intercept + log_slope * step)) ** 2)) log_rmse from med join ff using (feature) group by 1),
    fits as (select *, case when positive and log_rmse < linear_rmse then 'log' else 'linear' end kind from ff join er using (feature))"""


@query("detrend_fit", f"with {_U}, {_MED}, {_FIT} select feature, round(slope, 6) slope, round(intercept, 6) intercept, round(linear_rmse, 6) linear_rmse, positive, kind from fits")
def detrend_fit(t: Tables) -> DataFrame:
    fit = D.detrend_fit(D.step_medians(parts(t)[0]))
    return rounded(fit, ["slope", "intercept", "linear_rmse"]).select("feature", "slope", "intercept", "linear_rmse", "positive", "kind")


_FLAT = "flat as (select feature, step, value - case when kind = 'log' then exp(log_intercept + log_slope * step) else intercept + slope * step end value from u join fits using (feature))"


@query("detrend_apply", f"with {_U}, {_MED}, {_FIT}, {_FLAT} select step, feature, round(avg(value), 5) mean from flat group by 1, 2")
def detrend_apply(t: Tables) -> DataFrame:
    flat = D.detrend_apply(long(t).select("feature", "value", "step"), D.detrend_fit(D.step_medians(parts(t)[0])))
    return flat.groupBy("step", "feature").agg(F.round(F.avg("value"), 5).alias("mean"))


def scores(t: Tables) -> DataFrame:
    r, q = parts(t)
    return D.drift_score(r, q, ["f_mono"])


_SCORES = f"""{psi_sql('step')}, bs as (select feature, avg(value) m, stddev_pop(value) s from r group by 1), nw as (select step, feature, avg(value) mt from t group by 1, 2),
    sc as (select step, feature, case when feature = 'f_mono' then abs(mt - m) / s else psi end v, psi from nw join bs using (feature) join psi using (step, feature)), lv as (select *, case when v < 0.10 then 'STABLE' when v <= 0.25 then 'MODERATE' else 'SIGNIFICANT' end level from sc)"""


@query("drift_score", f"with {_U}, {_SCORES} select step, feature, round(v, 6) drift_score, level, round(psi, 6) psi from lv")
def drift_score(t: Tables) -> DataFrame:
    return rounded(scores(t), ["drift_score", "psi"])


@query("two_tier_report", f"""with {_U}, {_SCORES}, k as (select *, case level when 'SIGNIFICANT' then 2 when 'MODERATE' then 1 else 0 end n, feature in ('f_mono', 'f0') focal from lv),
    a as (select step, max(n) filter (where focal) f, max(v) filter (where focal) fm, 100.0 * count(*) filter (where not focal and n >= 1) / count(*) filter (where not focal) mp, 100.0 * count(*) filter (where not focal and n = 2) / count(*) filter (where not focal) sp from k group by 1)
    select step, case f when 2 then 'SIGNIFICANT' when 1 then 'MODERATE' else 'STABLE' end focal_level, round(fm, 6) focal_max, round(mp, 6) moderate_percent, round(sp, 6) significant_percent,
      case when f = 2 or sp >= 20 then 'SIGNIFICANT' when f = 1 or mp >= 20 then 'MODERATE' else 'STABLE' end overall_level from a""")
def two_tier_report(t: Tables) -> DataFrame:
    return rounded(D.two_tier_report(scores(t), ["f_mono", "f0"]), ["focal_max", "moderate_percent", "significant_percent"])


_METHODS = f"""{_MED}, {_FIT}, {_FLAT}, b as (select feature, step, avg(value) m, quantile_cont(value, [0.1, 0.25, 0.5, 0.75, 0.9]) q from u group by 1, 2), d as (select *, m - lag(m) over (partition by feature order by step) d from b),
    dp as (select feature, avg(d) dm, stddev_pop(d) ds from d where step <= 34 group by 1), fb as (select feature, avg(value) bm, stddev_pop(value) bs from flat where step <= 34 group by 1), fs as (select feature, step, avg(value) fm from flat where step >= 35 group by 1, 2),
    sh as (select feature, step, [(x - q[3]) / (q[4] - q[2]) for x in q] s from b), tr as (select feature, [avg(s[1]), avg(s[2]), avg(s[3]), avg(s[4]), avg(s[5])] ts from sh where step <= 34 group by 1),
    te as (select feature, list_sort(list_distinct(quantile_cont(value, {_PROBS}))) edges from r group by 1), tm as (select feature, edges[2:len(edges) - 1] mid from te),
    tc as (select feature, step, len([x for x in mid if x <= value]) bin, count(*) n from u join tm using (feature) group by all),
    tw as (select c.feature, s.step t, c.bin, sum(case when c.step = s.step then n else 0 end) p, sum(case when c.step < s.step then n else 0 end) q from tc c join spine s on c.step between s.step - 10 and s.step where s.step >= 35 group by all),
    tn as (select feature, t, sum(p) np, sum(q) nq from tw group by all having sum(p) > 0 and sum(q) > 0), tg as (select feature, t, np, nq, unnest(range(len(mid) + 1)) bin from tn join tm using (feature)),
    tz as (select feature, t, greatest(coalesce(p, 0) / np, 1e-4) p, greatest(coalesce(q, 0) / nq, 1e-4) q from tg left join tw using (feature, t, bin)), ty as (select feature, t, p / sum(p) over (partition by feature, t) p, q / sum(q) over (partition by feature, t) q from tz),
    tp as (select feature, t step, sum((p - q) * ln(p / q)) trailing_psi from ty group by all),
    methods as (select d.feature, d.step, tp.trailing_psi, abs((d - dm) / ds) delta_z, abs((fm - bm) / bs) detrended_shift, (abs(s[1] - ts[1]) + abs(s[2] - ts[2]) + abs(s[3] - ts[3]) + abs(s[4] - ts[4]) + abs(s[5] - ts[5])) / 5 shape_distance
      from d join dp using (feature) join fs on fs.feature = d.feature and fs.step = d.step join fb on fb.feature = d.feature join sh on sh.feature = d.feature and sh.step = d.step join tr on tr.feature = d.feature join tp on tp.feature = d.feature and tp.step = d.step)"""


@query("reference_methods", f"with {_U}, {_METHODS} select feature, step, round(delta_z, 5) delta_z, round(trailing_psi, 5) trailing_psi, round(detrended_shift, 5) detrended_shift, round(shape_distance, 5) shape_distance from methods")
def reference_methods(t: Tables) -> DataFrame:
    return rounded(D.reference_methods(long(t).select("feature", "value", "step"), 34, 35, 49), ["delta_z", "trailing_psi", "detrended_shift", "shape_distance"], 5)


@query("reference_summary", f"""with {_U}, {_METHODS} select case when step <= 41 then '35-41' else '42-49' end span, feature, round(avg(delta_z), 4) mean_delta_z, round(max(delta_z), 4) max_delta_z, round(avg(trailing_psi), 4) mean_trailing, round(avg(detrended_shift), 4) mean_detrended, round(max(shape_distance), 4) max_shape from methods group by 1, 2""")
def reference_summary(t: Tables) -> DataFrame:
    m = D.reference_methods(long(t).select("feature", "value", "step"), 34, 35, 49)
    span = F.when(F.col("step") <= 41, "35-41").otherwise("42-49").alias("span")
    return m.groupBy(span, "feature").agg(F.round(F.avg("delta_z"), 4).alias("mean_delta_z"), F.round(F.max("delta_z"), 4).alias("max_delta_z"), F.round(F.avg("trailing_psi"), 4).alias("mean_trailing"), F.round(F.avg("detrended_shift"), 4).alias("mean_detrended"), F.round(F.max("shape_distance"), 4).alias("max_shape"))


@query("feature_shift_l2", f"with {_U}, bs as (select feature, avg(value) m, stddev_pop(value) s from r group by 1), nw as (select step, feature, avg(value) mt from t group by 1, 2) select step, round(sqrt(sum(((mt - m) / s) ** 2)) / sqrt(count(*)), 6) shift_l2 from nw join bs using (feature) group by 1")
def feature_shift_l2(t: Tables) -> DataFrame:
    r, q = parts(t)
    return rounded(D.feature_shift_l2(r, q), ["shift_l2"])


BINS = [i / 10 for i in range(1, 10)]
SCORE_PSI_SQL = f"""sb as (select step, b, count(*) / sum(count(*)) over (partition by step) share from (select step, len([x for x in {BINS} if x <= score]) b from tx) group by 1, 2), sl as (select step, b, count(*) / sum(count(*)) over (partition by step) share from (select step, len([x for x in {BINS} if x <= score]) b from tx where y is not null) group by 1, 2),
    el as (select t.step t, e.step from spine t join (select distinct step from tx where y is not null) e on e.step <= t.step - 1 where t.step >= 35 qualify row_number() over (partition by t.step order by e.step desc) <= 5), ok as (select t from el group by t having count(*) >= 2 and t in (select step from tx)),
    rf as (select t, b, sum(share) / (select count(*) from el k where k.t = el.t) q from el join sl using (step) group by t, b), gr as (select t, unnest(range(10)) b from ok),
    zz as (select t, b, greatest(coalesce(q, 0), 1e-4) q, greatest(coalesce(share, 0), 1e-4) p from gr left join rf using (t, b) left join sb on sb.step = gr.t and sb.b = gr.b), yy as (select t, q / sum(q) over (partition by t) q, p / sum(p) over (partition by t) p from zz),
    score_psi as (select t step, sum((p - q) * ln(p / q)) psi from yy group by 1)"""


@query("score_psi", f"with {SCORE_PSI_SQL} select s.step, round(psi, 6) psi, case when psi is null then 'UNAVAILABLE' when psi >= 0.25 then 'CRITICAL' when psi >= 0.10 then 'WARNING' else 'OK' end status from spine s left join score_psi p on p.step = s.step where s.step >= 35")
def score_psi(t: Tables) -> DataFrame:
    return rounded(monitor.score_shift_channel(t.tx, t.spine(35), BINS, 5, 1), ["psi"])


_POOL = "el as (select t.step t, e.step from spine t join (select distinct step from tx) e on e.step <= t.step - 1 where t.step >= 35 qualify row_number() over (partition by t.step order by e.step desc) <= 5)"


@query("score_ks_channel", f"""with {_POOL}, {ks_sql('t', "select t, 'score' feature, score as value, 0 s from el join tx using (step) union all select step, 'score', score, 1 from tx where step >= 35")} select t step, round(ks, 6) ks, ks >= 0.10 alert from ks""")
def score_ks_channel(t: Tables) -> DataFrame:
    return rounded(monitor.score_ks_channel(t.tx, t.spine(35), 5, 1), ["ks"])


@query("positive_rate_channel", f"""with {_POOL}, a as (select t, avg(cast(score >= 0.435 as int)) pool from el join tx using (step) group by 1), b as (select step t, avg(cast(score >= 0.435 as int)) own from tx where step >= 35 group by 1)
    select t step, round(case when pool > 0 then own / pool end, 6) ratio, coalesce(own / pool < 0.5 or own / pool > 2, false) alert from a join b using (t)""")
def positive_rate_channel(t: Tables) -> DataFrame:
    return rounded(monitor.positive_rate_channel(t.tx, t.spine(35), 5, 1), ["ratio"])


_X = _V[:-1]
FOLDS = 3


def disc_sql(name: str, rows: str, by: str, features: list[str], key: str = "vec_id") -> str:
    """CTEs ``name``0 to ``name``: out-of-fold scores (by, key, fold, y, score) of rows (by, key, y, features)."""
    k = by + ", " if by else ""
    moments = ", ".join(f"avg({x}) filter (where y = {i}) m{i}_{x}, var_pop({x}) filter (where y = {i}) v{i}_{x}" for x in features for i in (0, 1))
    weight = ", ".join(f"coalesce(case when n1 * v1_{x} + n0 * v0_{x} > 0 then (m1_{x} - m0_{x}) / ((n1 * v1_{x} + n0 * v0_{x}) / (n1 + n0)) end, 0) w_{x}" for x in features)
    score = " + ".join(f"w_{x} * {x}" for x in features)
    using = f"using ({k}fold)"
    return f"""{name}0 as (select *, {key} % {FOLDS} fold from ({rows})), {name}1 as (select {k}fk fold, count(*) filter (where y = 1) n1, count(*) filter (where y = 0) n0, {moments} from {name}0, (select unnest(range({FOLDS})) fk) where fk <> fold group by {k}fk),
    {name}2 as (select {k}fold, {weight} from {name}1), {name} as (select {k}{key}, fold, y, {score} raw, round({score}, 9) score, {", ".join(f"{x}, w_{x}" for x in features)} from {name}0 join {name}2 {using})"""


def auc_sql(name: str, source: str, by: str) -> str:
    """CTE ``name`` (by, auc): the mean over folds."""
    k = by + ", " if by else ""
    return f"""{name}h as (select {k}fold, score s, count(*) n, sum(y) pos from {source} group by {k}fold, score), {name}c as (select {k}fold, s, n, pos, sum(pos) over (partition by {k}fold) p, sum(n) over (partition by {k}fold) total, sum(n - pos) over (partition by {k}fold order by s) - (n - pos) below from {name}h),
    {name}f as (select {k}fold, case when max(p) = 0 or max(p) = max(total) then 0.5 else sum(pos * (2 * below + n - pos)) / (2 * max(p) * (max(total) - max(p))) end auc from {name}c group by {k}fold), {name} as (select {k}avg(auc) auc from {name}f {f"group by {by}" if by else ""})"""


JUDGED_SQL = "judged as (select step t from spine where step >= 35 and (step % 5 = 0 or step in (35, 49)))"


def domain_sql(name: str, features: list[str]) -> str:
    """CTE ``name`` (step, n_target, domain_auc)."""
    rows = f"select t, vec_id, 1 y, {', '.join(features)} from vec join judged on step = t union all select t, vec_id, 0, {', '.join(features)} from vec, judged where step <= 34"
    return f"""{disc_sql(name + "s", rows, "t", features)}, {auc_sql(name + "a", name + "s", "t")}, {name}n as (select t, sum(y)::bigint n_target from {name}s group by t having sum(y) > 0),
    {name} as (select t step, n_target, case when n_target < 10 then 0.5 else auc end domain_auc from {name}n join {name}a using (t))"""


def judged(t: Tables) -> DataFrame:
    return monitor.cadence(t.spine(35))


_LEVEL = "case when domain_auc >= 0.85 then 'ALERT' when domain_auc >= 0.70 then 'MODERATE' else 'STABLE' end level"


@query("domain_auc", f"with {JUDGED_SQL}, {domain_sql('dm', _X)} select step, n_target, round(domain_auc, 6) domain_auc, {_LEVEL} from dm")
def domain_auc(t: Tables) -> DataFrame:
    """For each judged step: how well its vectors are told from those of the reference."""
    return rounded(discriminant.domain_auc(t.vec, _X, judged(t), 34, "vec_id"), ["domain_auc"])


@query("domain_auc_cadence", "with st as (select distinct step from tx) select step from st where step % 5 = 0 or step in (35, 49)")
def domain_auc_cadence(t: Tables) -> DataFrame:
    return monitor.cadence(t.steps())


_DROPS = {"all": [], "no_clock": ["f_mono"], "no_first": ["f_mono", "f0"]}


@query("domain_auc_ablation", f"with {JUDGED_SQL}, " + ", ".join(domain_sql(f"dm_{n}", [f for f in _V if f not in gone]) for n, gone in _DROPS.items()) + " " + " union all ".join(f"select '{n}' ablation, step, n_target, round(domain_auc, 6) domain_auc, {_LEVEL} from dm_{n}" for n in _DROPS))
def domain_auc_ablation(t: Tables) -> DataFrame:
    return rounded(discriminant.domain_auc_ablation(t.vec, _V, _DROPS, judged(t), 34, "vec_id"), ["domain_auc"])


_SIDED = "select vec_id, cast(side as int) y, {} from vec {}"


@query("in_window_cv_ap", f"""with {disc_sql("cv", _SIDED.format(", ".join(_X), "where step >= 35"), "", _X)}, ch as (select score s, count(*) n, sum(y) pos from cv group by score), cc as (select s, n, pos, sum(pos) over (order by s desc) tp, sum(n) over (order by s desc) alerts, sum(pos) over () p, sum(n) over () total from ch)
    select max(total)::bigint n, max(p)::bigint pos, round(sum(case when p > 0 then pos / p * tp / alerts end), 6) ap from cc""")
def in_window_cv_ap(t: Tables) -> DataFrame:
    return rounded(discriminant.in_window_cv_ap(t.vec.where("step >= 35").withColumn("y", F.col("side").cast("int")), _X, "vec_id"), ["ap"])


_BLOCKS = {**{f: [f] for f in _X[:4]}, "f0+f1": ["f0", "f1"]}
_REPEATS = 3


def drop_sql(name: str, rows: str, features: list[str], blocks: dict[str, list[str]], repeats: int) -> str:
    """CTE ``name`` (block, auc_drop, repeats) of rows (vec_id, y, features)."""
    used = [f for f in features if any(f in fs for fs in blocks.values())]
    tries = ", ".join(f"({r}, '{f}', {101 * r + features.index(f)})" for f in used for r in range(repeats))
    held = ", ".join(f"('{b}', '{f}')" for b, fs in blocks.items() for f in fs)
    value = lambda c: "case feature " + " ".join(f"when '{f}' then {c}{f}" for f in used) + " end"
    sides = ", ".join(f"{text} {side}" for side, text in grid("size"))
    return f"""{disc_sql(name + "d", rows, "", features)}, {auc_sql(name + "b", name + "d", "")}, {name}t as (select r as repeat, feature, seed::bigint seed from (values {tries}) v(r, feature, seed)), {name}h as (select * from (values {held}) v(block, feature)),
    {name}p as (select *, row_number() over (partition by fold order by vec_id) - 1 place, count(*) over (partition by fold) size from {name}d), {name}g as (select *, {sides} from {name}p),
    {name}a as (select vec_id, fold, y, raw, repeat, feature, {value("")} x, {value("w_")} wf, {permuted("place", "size", "seed", duck=True)} target from {name}g, {name}t),
    {name}m as (select a.vec_id, a.fold, a.y, a.repeat, block, round(first(a.raw) + sum(a.wf * ({value("g.").replace("feature", "a.feature")} - a.x)), 9) score from {name}a a join {name}g g on g.fold = a.fold and g.place = a.target join {name}h h on h.feature = a.feature group by all),
    {auc_sql(name + "c", name + "m", "block, repeat")}, {name} as (select block, avg({name}b.auc - {name}c.auc) auc_drop, count(*) repeats from {name}c, {name}b group by block)"""


@query("permutation_auc_drop", f"""with {drop_sql("pd", _SIDED.format(", ".join(_X[:4]), ""), _X[:4], _BLOCKS, _REPEATS)} select block, round(auc_drop, 6) auc_drop, repeats from pd""")
def permutation_auc_drop(t: Tables) -> DataFrame:
    return rounded(discriminant.permutation_auc_drop(t.vec.withColumn("y", F.col("side").cast("int")), _X[:4], _BLOCKS, "vec_id", FOLDS, _REPEATS), ["auc_drop"])


_ONES = {f: [f] for f in _X}
_SIDES = {"a": "step <= 34", "b": "step >= 35"}
_IMP = ", ".join(f"""{drop_sql("i" + n, _SIDED.format(", ".join(_X), "where " + w), _X, _ONES, 1)}, {n} as (select block feature, round(greatest(auc_drop, 0), 4) importance from i{n})""" for n, w in _SIDES.items())


def importances(t: Tables) -> tuple[DataFrame, DataFrame]:
    """What each feature is worth before and after the reference ends: the loss of AUC when it is shuffled, 0 where there is none."""
    rows = t.vec.withColumn("y", F.col("side").cast("int"))
    drops = (discriminant.permutation_auc_drop(rows.where(w), _X, _ONES, "vec_id", FOLDS, 1) for w in _SIDES.values())
    return tuple(d.select(F.col("block").alias("feature"), F.round(F.greatest("auc_drop", F.lit(0.0)), 4).alias("importance")) for d in drops)


@query("share_concentration", f"""with {_IMP}, k as (select importance v, row_number() over (order by importance desc, feature) r, row_number() over (order by importance, feature) up from a)
    select round(2 * sum(up * v) / (count(*) * sum(v)) - (count(*) + 1) / count(*), 6) gini, """ + ", ".join(f"round(sum(case when r <= {k} then v else 0 end) / sum(v), 6) top{k}" for k in (1, 3, 5, 10)) + " from k")
def share_concentration(t: Tables) -> DataFrame:
    return rounded(D.share_concentration(importances(t)[0], "importance", "feature"), ["gini", "top1", "top3", "top5", "top10"])


@query("importance_compare", f"""with {_IMP}, j as (select feature, a.importance a, b.importance b, row_number() over (order by a.importance desc, feature) ra, row_number() over (order by b.importance desc, feature) rb from a join b using (feature)),
    m as (select quantile_cont(a, 0.5) ma, quantile_cont(b, 0.5) mb from j)
    select feature, a, b, ra rank_a, rb rank_b, round(case when b > 0 then a / b end, 6) ratio, case when a >= ma then 'high' else 'low' end || '/' || case when b >= mb then 'high' else 'low' end quadrant, case when abs(ra - rb) <= 1 then 'agree' when abs(ra - rb) <= 3 then 'close' else 'differ' end agreement from j, m""")
def importance_compare(t: Tables) -> DataFrame:
    return rounded(D.importance_compare(*importances(t)), ["ratio"])


@query("importance_kendall", f"with {_IMP}, j as (select feature, a.importance x, b.importance y from a join b using (feature)) select round(sum(sign(p.x - q.x) * sign(p.y - q.y)) / nullif(sqrt(sum(abs(sign(p.x - q.x))) * sum(abs(sign(p.y - q.y)))), 0), 6) tau from j p join j q on p.feature < q.feature")
def importance_kendall(t: Tables) -> DataFrame:
    a, b = importances(t)
    return rounded(D.kendall(a.join(b.withColumnRenamed("importance", "other"), "feature"), "importance", "other", "feature"), ["tau"])


_WIN = "wn as (select \"window\" w, lo, hi from windows where \"window\" in ('early', 'drift', 'test'))"
_COLS = ", ".join(_X)


def _ap_sql(name: str, source: str) -> str:
    """CTE ``name`` (w, ap) of scored rows (w, y, score)."""
    return f"""{name}h as (select w, score s, count(*) n, sum(y) pos from {source} group by w, score), {name}c as (select w, n, pos, sum(pos) over o tp, sum(n) over o alerts, sum(pos) over (partition by w) p from {name}h window o as (partition by w order by s desc)),
    {name} as (select w, sum(case when p > 0 then pos / p * tp / alerts end) ap from {name}c group by w)"""


@query("drift_verdict", f"""with {_WIN}, {disc_sql("da", f"select w, vec_id, 1 y, {_COLS} from vec join wn on step between lo and hi union all select w, vec_id, 0, {_COLS} from vec, wn where step <= 34", "w", _X)}, {auc_sql("dauc", "da", "w")}, u as (unpivot (select step, {_COLS} from vec) on {_COLS} into name feature value value),
    {ks_sql("w", "select w, feature, value, 1 s from u join wn on step between lo and hi union all select w, feature, value, 0 from u, wn where step <= 34")}, mk as (select w, quantile_cont(ks, 0.5) median_ks from ks group by w),
    {disc_sql("iw", f"select w, vec_id, cast(side as int) y, {_COLS} from vec join wn on step between lo and hi", "w", _X)}, {_ap_sql("iap", "iw")},
    rm as (select count(*) filter (where side) n1, count(*) filter (where not side) n0, {", ".join(f"avg({x}) filter (where {'' if i else 'not '}side) m{i}_{x}, var_pop({x}) filter (where {'' if i else 'not '}side) v{i}_{x}" for x in _X for i in (0, 1))} from vec where step <= 34),
    tr as (select w, cast(side as int) y, round({" + ".join(f"(m1_{x} - m0_{x}) / ((n1 * v1_{x} + n0 * v0_{x}) / (n1 + n0)) * {x}" for x in _X)}, 9) score from vec join wn on step between lo and hi, rm), {_ap_sql("tap", "tr")},
    m as (select w, auc domain_auc, median_ks, iap.ap in_window_ap, tap.ap transferred_ap from dauc join mk using (w) join iap using (w) join tap using (w))
    select w "window", round(domain_auc, 6) domain_auc, round(median_ks, 6) median_ks, round(in_window_ap, 6) in_window_ap, round(transferred_ap, 6) transferred_ap, case when domain_auc >= 0.80 or median_ks >= 0.30 then 'covariate' when in_window_ap >= 5 * transferred_ap then 'concept' else 'none' end verdict from m""")
def drift_verdict(t: Tables) -> DataFrame:
    """Domain AUC, KS and both APs of each later window, and what they say of its drift."""
    named = t.windows().where(F.col("window").isin("early", "drift", "test"))
    m = discriminant.drift_metrics(t.vec.withColumn("y", F.col("side").cast("int")), _X, named, 34, "vec_id", folds=FOLDS)
    return rounded(D.drift_verdict(m), ["domain_auc", "median_ks", "in_window_ap", "transferred_ap"])
