"""Window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steplens.operators import profile, ranking
from steplens.operators import windows as W
from steplens.operators.joins import score_histogram
from steplens.plans.profiles import rounded
from steplens.plans.registry import query
from steplens.sources.tables import Tables

COUNTS_SQL = "select step, count(tx_id) total, count(y) labelled, count(*) filter (where y = 1) positive from spine left join tx using (step) group by step"


def counts(t: Tables) -> DataFrame:
    return profile.step_label_counts(t.tx, t.spine())


@query("rolling_prevalence", f"""with c as ({COUNTS_SQL})
    select a.step, coalesce(sum(b.positive), 0)::bigint rolling_positive, coalesce(sum(b.labelled), 0)::bigint rolling_labelled, round(case when sum(b.labelled) > 0 then sum(b.positive) / sum(b.labelled) end, 6) rolling_prevalence
    from c a left join c b on b.step between a.step - 5 and a.step - 1 where a.step % 6 <> 5 and (b.step is null or b.step % 6 <> 5) group by a.step union all
    select a.step, 0, 0, null from c a where false""")
def rolling_prevalence(t: Tables) -> DataFrame:
    found = W.rolling_prevalence(counts(t).where("step % 6 <> 5"), lag=1, width=5)
    return rounded(found, ["rolling_prevalence"]).select("step", "rolling_positive", "rolling_labelled", "rolling_prevalence")


@query("last_n_eligible", f"""with c as ({COUNTS_SQL}), e as (select step from c where positive >= 15)
    select t.step t, e.step, row_number() over (partition by t.step order by e.step desc) recency from spine t join e on e.step <= t.step - 2 where t.step >= 35 qualify recency <= 3""")
def last_n_eligible(t: Tables) -> DataFrame:
    return W.last_n_eligible(t.spine(35), counts(t).where("positive >= 15"), 3, 2).select("t", "step", "recency")


@query("lag_k", "select tx_id, step, " + ", ".join(f"lag(tx_id, {k}) over (partition by input_address order by step, tx_id) tx_id_lag{k}" for k in range(1, 6)) + " from addr_tx join tx using (tx_id)")
def lag_k(t: Tables) -> DataFrame:
    own = t.addr_tx.join(t.tx.select("tx_id", "step"), "tx_id")
    return W.lag_k(own, "input_address", ["step", "tx_id"], "tx_id", [1, 2, 3, 4, 5]).drop("input_address")


@query("step_delta", "select step, round(m, 6) m, round(m - lag(m) over (order by step), 6) delta_m from (select step, avg(score) m from tx group by step)")
def step_delta(t: Tables) -> DataFrame:
    return rounded(W.step_delta(t.tx.groupBy("step").agg(F.avg("score").alias("m")), ["m"]), ["m", "delta_m"])


@query("trailing_pool", "select t.step t, count(*) n, round(avg(score), 6) mean_score from spine t join tx x on x.step between t.step - 10 and t.step - 1 where t.step >= 35 group by 1")
def trailing_pool(t: Tables) -> DataFrame:
    per_step = t.tx.groupBy("step").agg(F.count("*").alias("n"), F.sum("score").alias("s"))
    pool = W.trailing_pool(per_step, t.spine(35), 10)
    return pool.groupBy("t").agg(F.sum("n").alias("n"), F.round(F.sum("s") / F.sum("n"), 6).alias("mean_score"))


@query("streak", f"""with c as (select step, positive >= 20 hit from ({COUNTS_SQL})), i as (select *, sum(case when hit then 0 else 1 end) over (order by step) g from c)
    select step, hit, sum(case when hit then 1 else 0 end) over (partition by g order by step)::bigint streak from i""")
def streak(t: Tables) -> DataFrame:
    return W.streak(counts(t).select("step", (F.col("positive") >= 20).alias("hit")), "hit")


_H = "select step, score, count(*) n, sum(y) pos from tx where y is not null and step >= 35 group by 1, 2"


@query("cumulative_curve", f"with h as ({_H}) select step, score, n, pos::bigint pos, sum(pos) over (partition by step order by score desc)::bigint tp, sum(n) over (partition by step order by score desc)::bigint alerts, sum(pos) over (partition by step)::bigint p, sum(n) over (partition by step)::bigint total from h")
def cumulative_curve(t: Tables) -> DataFrame:
    return ranking.cumulative_curve(score_histogram(t.tx.where("step >= 35"), "score", "y", ["step"]), ["step"])


@query("cumulative_counts", f"with c as ({COUNTS_SQL}) select step, sum(total) over (order by step)::bigint cumulative_total, sum(labelled) over (order by step)::bigint cumulative_labelled from c")
def cumulative_counts(t: Tables) -> DataFrame:
    return W.cumulative_counts(counts(t), ["total", "labelled"]).select("step", "cumulative_total", "cumulative_labelled")


@query("dense_topk", "select step, tx_id, row_number() over (partition by step order by score desc, tx_id) as rank from tx where step >= 35 qualify row_number() over (partition by step order by score desc, tx_id) <= 20")
def dense_topk(t: Tables) -> DataFrame:
    return ranking.topk(t.tx.where("step >= 35"), 20, ["step"]).select("step", "tx_id", "rank")


@query("average_rank", f"with c as ({COUNTS_SQL}) select step, rank() over (order by positive) + (count(*) over (partition by positive) - 1) / 2 as rank from c")
def average_rank(t: Tables) -> DataFrame:
    return counts(t).select("step", profile.average_rank("positive", []).alias("rank"))


@query("lorenz_cumshare", f"with c as ({COUNTS_SQL}) select step, row_number() over (order by positive desc, step) as rank, round(sum(positive) over (order by positive desc, step rows unbounded preceding) / sum(positive) over (), 6) share from c")
def lorenz_cumshare(t: Tables) -> DataFrame:
    return rounded(W.lorenz(counts(t).select("step", "positive"), "positive", "step"), ["share"]).select("step", "rank", "share")
