"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steplens.operators import joins, ranking, rows
from steplens.plans.registry import query
from steplens.sources.tables import Tables


@query("join_label", "select s.address, s.step, c.y from (select distinct address, step from wallet_snap) s left join (select concat('C', c_custkey) address, case when c_acctbal < 0 then 1 else 0 end y from customer where c_custkey % 2 = 0) c using (address)")
def join_label(t: Tables) -> DataFrame:
    labels = t.raw("customer").where("c_custkey % 2 = 0").selectExpr("concat('C', c_custkey) AS address", "CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS y")
    return t.wallet_snap.select("address", "step").distinct().join(labels, "address", "left")


@query("join_scores", """select step, count(*) n, count(*) filter (where y_true is distinct from y) disagree, count(*) filter (where saved is null) unscored from tx
    left join (select tx_id, score saved, case when tx_id % 100 = 0 then 1 else y end y_true from tx where step >= 35 and tx_id % 7 <> 0) using (tx_id) where step >= 35 group by step""")
def join_scores(t: Tables) -> DataFrame:
    saved = t.tx.where("step >= 35 AND tx_id % 7 <> 0").selectExpr("tx_id", "score AS saved", "CASE WHEN tx_id % 100 = 0 THEN 1 ELSE y END AS y_true")
    found = joins.join_scores(t.tx.where("step >= 35").select("tx_id", "step", "y"), saved)
    return found.groupBy("step").agg(F.count("*").alias("n"), F.count_if(~F.col("agrees")).alias("disagree"), F.count_if(F.col("saved").isNull()).alias("unscored"))


@query("join_tables_outer", """with a as (select step, count(*) n_tx from tx where step <= 40 group by step), b as (select step, count(*) n_ev from ev where step >= 10 group by step)
    select step, n_tx, n_ev from a full join b using (step)""")
def join_tables_outer(t: Tables) -> DataFrame:
    a = t.tx.where("step <= 40").groupBy("step").agg(F.count("*").alias("n_tx"))
    b = t.ev.where("step >= 10").groupBy("step").agg(F.count("*").alias("n_ev"))
    return a.join(b, "step", "full")


@query("asof_prior_snapshot", """with s as (select distinct address, step snap, total_txs from wallet_snap)
    select a.tx_id, t.step, s.snap prior_step, s.total_txs prior_value from addr_tx a join tx t using (tx_id) asof left join s on a.input_address = s.address and t.step > s.snap""")
def asof_prior_snapshot(t: Tables) -> DataFrame:
    events = t.addr_tx.withColumnRenamed("input_address", "address").join(t.tx.select("tx_id", "step"), "tx_id")
    found = joins.asof_prior_snapshot(events, t.wallet_snap, "address", "step", "total_txs", ["tx_id"])
    return found.select("tx_id", "step", "prior_step", "prior_value")


@query("semi_universe", "select tx_id, output_address from tx_addr where tx_id in (select tx_id from tx where step <= 34)")
def semi_universe(t: Tables) -> DataFrame:
    return t.tx_addr.join(t.tx.where("step <= 34").select("tx_id"), "tx_id", "left_semi").select("tx_id", "output_address")


@query("anti_reference", "select distinct address, step from wallet_snap s where not exists (select 1 from wallet_snap r where r.address = s.address and r.step = s.step and r.total_txs >= 3)")
def anti_reference(t: Tables) -> DataFrame:
    return t.wallet_snap.join(t.wallet_snap.where("total_txs >= 3").select("address", "step"), ["address", "step"], "left_anti").select("address", "step").distinct()


@query("bridge_tx_addr_tx", """with o as (select * from addr_tx join tx using (tx_id)), m as (select input_address, min(step) ms from o group by 1)
    select tx_id, step, min(ms) min_step, min(ms) < step bridged from o join m using (input_address) group by tx_id, step""")
def bridge_tx_addr_tx(t: Tables) -> DataFrame:
    return joins.bridge(t.addr_tx.withColumnRenamed("input_address", "address"), t.tx)


@query("range_window", 'select "window", count(*) n, count(y) labelled from tx join windows on step between lo and hi group by 1')
def range_window(t: Tables) -> DataFrame:
    return rows.window_mask(t.tx, t.windows()).groupBy("window").agg(F.count("*").alias("n"), F.count("y").alias("labelled"))


@query("cross_threshold", """with g as (select unnest(range(1, 20)) / 20 tau)
    select tau, count(*) filter (where score >= tau and y = 1) tp, count(*) filter (where score >= tau and y = 0) fp, count(*) filter (where score < tau and y = 1) fn from tx, g where y is not null group by tau""")
def cross_threshold(t: Tables) -> DataFrame:
    return joins.cross_threshold(joins.score_histogram(t.tx, "score", "y"), [i / 20 for i in range(1, 20)])


#: Draws of the bootstraps.
DRAWS = 1000
DRAWS_SQL = f"""select draw, 35 + {joins.drawn('draw', 'slot')} % 15 step, count(*) weight
    from (select unnest(range({DRAWS})) draw), (select unnest(range(15)) slot) group by 1, 2"""


@query("cross_draws", f"""with w as ({DRAWS_SQL}), s as (select step, count(*) n, sum(y) pos from tx where y is not null and step >= 35 group by step)
    select draw, sum(weight * n)::bigint n, sum(weight * pos)::bigint pos from w join s using (step) group by draw""")
def cross_draws(t: Tables) -> DataFrame:
    weights = joins.draw_weights(t.spark, DRAWS, list(range(35, 50)))
    by_step = t.tx.where("y IS NOT NULL AND step >= 35").groupBy("step").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    return weights.join(by_step, "step").groupBy("draw").agg(F.sum(F.expr("weight * n")).alias("n"), F.sum(F.expr("weight * pos")).alias("pos"))


@query("set_union_ids", "select tx_id from addr_tx where tx_id % 2 = 0 union select tx_id from tx_addr")
def set_union_ids(t: Tables) -> DataFrame:
    return t.addr_tx.where("tx_id % 2 = 0").select("tx_id").union(t.tx_addr.select("tx_id")).distinct()


@query("set_diff_both", "select 'left' side, tx_id from (select tx_id from addr_tx except select tx_id from tx_addr) union all select 'right', tx_id from (select tx_id from tx_addr except select tx_id from addr_tx where tx_id % 2 = 0)")
def set_diff_both(t: Tables) -> DataFrame:
    a, b = t.addr_tx.select("tx_id").distinct(), t.tx_addr.select("tx_id").distinct()
    left = a.join(b, "tx_id", "left_anti").select(F.lit("left").alias("side"), "tx_id")
    right = b.join(a.where("tx_id % 2 = 0"), "tx_id", "left_anti").select(F.lit("right").alias("side"), "tx_id")
    return left.unionByName(right)


@query("set_intersect", "select tx_id from addr_tx intersect select tx_id from tx_addr")
def set_intersect(t: Tables) -> DataFrame:
    return t.addr_tx.select("tx_id").intersect(t.tx_addr.select("tx_id"))


@query("edge_union_distinct", "select tx_id1, tx_id2 from tx_tx union select tx_id2, tx_id1 from tx_tx where tx_id1 % 2 = 0")
def edge_union_distinct(t: Tables) -> DataFrame:
    return t.tx_tx.unionByName(t.tx_tx.where("tx_id1 % 2 = 0").selectExpr("tx_id2 AS tx_id1", "tx_id1 AS tx_id2")).distinct()


@query("signal_union", "select step, 'tx' source, count(*) n, null::bigint users from tx group by step union all select step, 'ev', count(*), count(distinct user_id) from ev group by step")
def signal_union(t: Tables) -> DataFrame:
    a = t.tx.groupBy("step").agg(F.count("*").alias("n")).withColumn("source", F.lit("tx"))
    b = t.ev.groupBy("step").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users")).withColumn("source", F.lit("ev"))
    return a.unionByName(b, allowMissingColumns=True)
