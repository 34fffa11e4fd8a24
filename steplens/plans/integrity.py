"""Integrity and de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steplens.operators import integrity as I
from steplens.plans.registry import query
from steplens.sources.tables import Tables


@query("key_uniqueness", """select count(*) as "rows", count(distinct k) distinct_ids, count(k) - count(distinct k) duplicates, count(*) - count(k) blank_ids from
    (select case when l_orderkey % 50 = 0 then null else l_orderkey end k from lineitem)""")
def key_uniqueness(t: Tables) -> DataFrame:
    keys = t.raw("lineitem").selectExpr("CASE WHEN l_orderkey % 50 = 0 THEN NULL ELSE l_orderkey END AS k")
    return I.key_uniqueness(keys, "k")


_AUDIT = "CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 7 = 1 THEN 'NaN' WHEN event_id % 7 = 2 THEN 'abc' ELSE '1.5' END AS a", "CASE WHEN event_id % 5 = 0 THEN NULL ELSE props END AS b"


@query("cell_audit", f"""with c as (select {_AUDIT[0]}, {_AUDIT[1]} from events), u as (select 'a' "column", a v from c union all select 'b', b from c)
    select "column", count(*) filter (where v is null or trim(v) = '') blank, count(*) filter (where trim(v) <> '' and try_cast(v as double) is null) non_numeric,
      count(*) filter (where isnan(try_cast(v as double))) nan from u group by 1""")
def cell_audit(t: Tables) -> DataFrame:
    return I.cell_audit(t.raw("events").selectExpr(*_AUDIT), ["a", "b"])


@query("class_domain", "select cls, count(*) n, cls in (1, 2) allowed from tx group by cls")
def class_domain(t: Tables) -> DataFrame:
    return I.class_domain(t.tx, "cls", [1, 2])


@query("step_domain", "select min(step) as first, max(step) as last, count(distinct step) distinct_steps, count(*) filter (where step not between 1 and 45) invalid_rows, count(distinct step) filter (where step between 1 and 45) = 45 contiguous from tx")
def step_domain(t: Tables) -> DataFrame:
    return I.step_domain(t.tx, "step", 45)


@query("snapshot_dedup", "select l_orderkey, l_linenumber, l_partkey, l_extendedprice from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_extendedprice, l_shipdate) = 1")
def snapshot_dedup(t: Tables) -> DataFrame:
    kept = I.snapshot_dedup(t.raw("lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"])
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("dup_pairs", """with p as (select address, step, count(*) n from wallet_snap group by 1, 2), a as (select address, sum(n) r from p group by 1)
    select count(*) filter (where n > 1) duplicate_pairs, sum(n - 1)::bigint extra_rows, (select max(r) from a)::bigint max_rows_per_key from p""")
def dup_pairs(t: Tables) -> DataFrame:
    return I.dup_pairs(t.wallet_snap, "address", "step")


@query("declared_vs_observed", """with a as (select address, min(total_txs) lo, max(total_txs) hi, count(*) n from wallet_snap group by 1)
    select count(*) keys, count(*) filter (where lo <> hi) conflicting, count(*) filter (where n <> hi) count_differs from a""")
def declared_vs_observed(t: Tables) -> DataFrame:
    return I.declared_vs_observed(t.wallet_snap, "address", "total_txs")


@query("class_mismatch", """select count(*) as "rows", count(*) filter (where l.tx_id is null) missing, count(*) filter (where l.tx_id is not null and l.c is distinct from t.cls) different
    from tx t left join (select tx_id, case when tx_id % 40 = 0 then 3 else cls end c from tx where tx_id % 9 <> 0) l using (tx_id)""")
def class_mismatch(t: Tables) -> DataFrame:
    lookup = t.tx.where("tx_id % 9 <> 0").selectExpr("tx_id", "CASE WHEN tx_id % 40 = 0 THEN 3 ELSE cls END AS c")
    return I.class_mismatch(t.tx, lookup, "tx_id", "cls", "c")


@query("edge_audit", """with u as (select distinct input_address a from addr_tx where tx_id % 5 <> 0), v as (select distinct output_address b from tx_addr where tx_id % 5 <> 0),
    d as (select distinct input_address, output_address from addr_addr)
    select (select count(*) from addr_addr) edges, (select count(*) from d) unique_edges, 0::bigint self_loops, 0::bigint blank_ends,
      (select count(distinct input_address) from addr_addr) unique_src, (select count(distinct input_address) from addr_addr where input_address not in (select a from u)) src_outside,
      (select count(distinct output_address) from addr_addr) unique_dst, (select count(distinct output_address) from addr_addr where output_address not in (select b from v)) dst_outside,
      (select count(*) from (select input_address from addr_addr union select output_address from addr_addr)) unique_nodes,
      (select count(*) from addr_addr) - (select count(*) from d) duplicates""")
def edge_audit(t: Tables) -> DataFrame:
    return I.edge_audit(t.addr_addr, "input_address", "output_address", t.addr_tx.where("tx_id % 5 <> 0").select("input_address"), t.tx_addr.where("tx_id % 5 <> 0").select("output_address"))


def _sets(t: Tables) -> dict[str, DataFrame]:
    return {"tx": t.tx.select("tx_id"), "in": t.addr_tx.where("tx_id % 2 = 0").select("tx_id"), "out": t.tx_addr.select("tx_id")}


@query("cross_reference", """with s as (select 'tx' k, tx_id id from tx union select 'in', tx_id from addr_tx where tx_id % 2 = 0 union select 'out', tx_id from tx_addr),
    m as (select id, max(case when k = 'tx' then 1 else 0 end) a, max(case when k = 'in' then 1 else 0 end) b, max(case when k = 'out' then 1 else 0 end) c from s group by id)
    select unnest(['size:tx', 'size:in', 'size:out', 'both:tx:in', 'only:tx:in', 'only:in:tx', 'both:tx:out', 'only:tx:out', 'only:out:tx', 'both:in:out', 'only:in:out', 'only:out:in']) as name,
      unnest([sum(a), sum(b), sum(c), sum(a * b), sum(a * (1 - b)), sum(b * (1 - a)), sum(a * c), sum(a * (1 - c)), sum(c * (1 - a)), sum(b * c), sum(b * (1 - c)), sum(c * (1 - b))])::bigint n from m""")
def cross_reference(t: Tables) -> DataFrame:
    return I.cross_reference(_sets(t))


#: Lines of a table whose keys one task sorts.
PART_ROWS = 1 << 20


@query("blank_equals_linkless", """select (select count(*) from (select tx_id from tx except select tx_id from tx_addr except select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem))) only_left,
    0::bigint only_right, (select count(*) from (select tx_id from tx except select tx_id from tx_addr except select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem))) = 0 "equal" """)
def blank_equals_linkless(t: Tables) -> DataFrame:
    # Keys in order shrink so much as they travel that tasks put together by bytes would sort tens of millions of them at once.
    parts = max(8, t.lines.count() // PART_ROWS)
    # Whether there is a link does not depend on how often it stands, so none are gathered first.
    lines = t.lines.select("tx_id").repartition(parts, "tx_id")
    blank = t.raw("orders").select(F.col("o_orderkey").alias("tx_id")).repartition(parts, "tx_id").join(lines, "tx_id", "left_anti")
    linkless = t.tx.select("tx_id").repartition(parts, "tx_id").join(lines, "tx_id", "left_anti")
    return I.sets_equal(blank, linkless)


@query("integrity_rules", """with m as (select 'only:tx:out' as name, (select count(*) from tx where tx_id not in (select tx_id from tx_addr)) n union all select 'size:tx', (select count(*) from tx))
    select r.name, r.kind, m.n, r.bound from (values ('only:tx:out', '=', 0, 'quality'), ('size:tx', '>=', 1, 'failure'), ('absent', '=', 0, 'failure')) r(name, op, bound, kind)
    left join m using (name) where not coalesce(case op when '=' then n = bound when '>=' then n >= bound end, false)""")
def integrity_rules(t: Tables) -> DataFrame:
    rules = t.spark.createDataFrame([("only:tx:out", "=", 0, "quality"), ("size:tx", ">=", 1, "failure"), ("absent", "=", 0, "failure")], "name string, op string, bound int, kind string")
    return I.integrity_rules(I.cross_reference(_sets(t)), rules)
