"""Directed edge lists: degrees, multiplicity, availability by step, history, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from steplens.operators.components import connected_components
from steplens.operators.joins import asof_prior_snapshot
from steplens.operators.windows import lag_k
from steplens.sources.scratch import materialise, parts_for


def degrees(nodes: DataFrame, edges: DataFrame, node: str, src: str, dst: str) -> DataFrame:
    """In, out and total degree of every node of the universe, 0 included; ends outside it are left out."""
    ends = edges.select(F.explode(F.array(F.struct(F.col(src).alias("n"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col(dst).alias("n"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    by_node = ends.groupBy(F.col("n").alias(node)).agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    return nodes.select(node).distinct().join(by_node, node, "left").fillna(0, ["out_degree", "in_degree"]).withColumn("degree", F.col("out_degree") + F.col("in_degree"))


def degree_histogram(deg: DataFrame, c: str = "degree") -> DataFrame:
    """Nodes of each degree."""
    return deg.groupBy(c).agg(F.count("*").alias("nodes"))


def degree_summary(deg: DataFrame, c: str = "degree", top: int = 20) -> DataFrame:
    """Mean, quantiles and greatest degree, how many different ones there are, and the ``top`` greatest of nodes, in order."""
    base = deg.agg(F.count("*").alias("nodes"), F.avg(c).alias("mean"), *[F.expr(f"percentile({c}, {p})").alias(a) for p, a in ((0.5, "median"), (0.95, "p95"), (0.99, "p99"))], F.max(c).alias("greatest"), F.avg(F.when(F.col(c) > 0, F.col(c))).alias("positive_mean"))
    h = degree_histogram(deg, c)
    kinds = h.agg(F.count("*").alias("distinct_degrees"))
    first = h.orderBy(F.desc(c)).limit(top).select(F.explode(F.array_repeat(c, F.least(F.col("nodes"), F.lit(top)).cast("int"))).alias("d"))
    tops = first.agg(F.slice(F.sort_array(F.collect_list("d"), False), 1, top).alias("top_degrees"))  # top * top values at most
    return base.crossJoin(F.broadcast(kinds)).crossJoin(F.broadcast(tops))  # one row each


def edge_multiplicity(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Edges, distinct pairs, repeated edges, self-loops, and edge rows whose reverse exists (a loop is its own)."""
    pairs = edges.groupBy(src, dst).agg(F.count("*").alias("n"))
    back = pairs.select(F.col(dst).alias(src), F.col(src).alias(dst), F.lit(1).alias("_back"))
    own = pairs.join(back, [src, dst], "left")
    n = F.col("n")
    return own.agg(F.sum("n").alias("edges"), F.count("*").alias("unique_pairs"), F.sum(n - 1).alias("repeated"), F.sum(F.when(F.col(src) == F.col(dst), n).otherwise(0)).alias("self_loops"), F.sum(F.when(F.col("_back").isNotNull(), n).otherwise(0)).alias("reciprocal"))


def isolated_nodes(nodes: DataFrame, edges: DataFrame, node: str, src: str, dst: str) -> DataFrame:
    """Nodes without edges, and ends outside the universe, with what they are."""
    ends = edges.select(F.col(src).alias(node)).union(edges.select(F.col(dst).alias(node))).distinct().withColumn("_e", F.lit(1))
    both = nodes.select(node).distinct().withColumn("_n", F.lit(1)).join(ends, node, "full")
    return both.where("_e IS NULL OR _n IS NULL").select(node, F.when(F.col("_e").isNull(), "isolated").otherwise("outside").alias("kind"))


def hubs(deg: DataFrame, node: str, top: int = 10) -> DataFrame:
    return deg.orderBy(F.desc("degree"), node).limit(top)


def degree_ccdf(deg: DataFrame, grid: list[int], c: str = "degree") -> DataFrame:
    """Share of nodes with at least each degree of the grid, from the histogram of degrees."""
    h = deg.groupBy(c).agg(F.count("*").alias("n"))
    points = h.select(c, "n", F.explode(F.array(*[F.lit(g) for g in grid])).alias("x"))
    return points.groupBy("x").agg((F.sum(F.when(F.col(c) >= F.col("x"), F.col("n")).otherwise(0)) / F.sum("n")).alias("share"))


def weak_components(nodes: DataFrame, edges: DataFrame, node: str, src: str, dst: str) -> DataFrame:
    """(node, component) for every node of the universe; a node without edges is its own."""
    found = connected_components(edges, src, dst).withColumnRenamed("node", node)
    return nodes.select(node).distinct().join(found, node, "left").select(node, F.coalesce("component", node).alias("component"))


def component_summary(components: DataFrame) -> DataFrame:
    sizes = components.groupBy("component").agg(F.count("*").alias("size"))
    return sizes.agg(F.count("*").alias("components"), F.max("size").alias("largest"), (100.0 * F.max("size") / F.sum("size")).alias("largest_percent"), F.count_if(F.col("size") == 1).alias("singletons"))


def edge_time_profile(edges: DataFrame, steps: DataFrame, src: str, dst: str, node: str, step: str = "step") -> DataFrame:
    """Edges inside a step, to a later one and back in time."""
    a = steps.select(F.col(node).alias(src), F.col(step).alias("_a"))
    b = steps.select(F.col(node).alias(dst), F.col(step).alias("_b"))
    j = edges.join(a, src).join(b, dst)
    return j.agg(F.count("*").alias("edges"), F.count_if(F.expr("_a = _b")).alias("intra"), F.count_if(F.expr("_a < _b")).alias("forward"), F.count_if(F.expr("_a > _b")).alias("backward"))


def first_seen(*seen: DataFrame) -> DataFrame:
    """The least step of each address over several (address, step) tables."""
    out = seen[0].select("address", "step")
    for s in seen[1:]:
        out = out.unionByName(s.select("address", "step"))
    return out.groupBy("address").agg(F.min("step").alias("first_step"))


def edge_availability(edges: DataFrame, first: DataFrame, src: str, dst: str) -> DataFrame:
    """The step at which an address-to-address edge becomes visible: the later of its ends' first steps."""
    a = first.select(F.col("address").alias(src), F.col("first_step").alias("_a"))
    b = first.select(F.col("address").alias(dst), F.col("first_step").alias("_b"))
    return edges.join(a, src).join(b, dst).select(src, dst, F.greatest("_a", "_b").alias("available"))


def edges_up_to(edges: DataFrame, cut: int, available: str = "available") -> DataFrame:
    return edges.where(F.col(available) <= cut)


def tx_min_address_seen(membership: DataFrame, first: DataFrame, tx: str = "tx_id") -> DataFrame:
    return membership.select(tx, "address").distinct().join(first, "address").groupBy(tx).agg(F.min("first_step").alias("min_seen"))


def address_context(tx: DataFrame, membership: DataFrame, first: DataFrame, step: str = "step") -> DataFrame:
    """seen (an address seen before the own step), only_unseen, or no_linkage, for each transaction."""
    least = tx_min_address_seen(membership, first)
    kind = F.when(F.col("min_seen").isNull(), "no_linkage").when(F.col("min_seen") < F.col(step), "seen").otherwise("only_unseen")
    return tx.join(least, "tx_id", "left").withColumn("context", kind)


def address_history_mean(addresses: DataFrame, snapshots: DataFrame, value: str, cut: int) -> DataFrame:
    """Mean of an address's snapshots up to a step; the mean over all those snapshots where it has none."""
    past = snapshots.where(F.col("step") <= cut)
    own = past.groupBy("address").agg(F.avg(value).alias("own"))
    whole = past.agg(F.avg(value).alias("whole"))
    out = addresses.select("address").distinct().join(own, "address", "left").crossJoin(F.broadcast(whole))  # one row
    return out.select("address", F.coalesce("own", "whole").alias("history_mean"), F.col("own").isNotNull().alias("has_history"))


def lag_features(membership: DataFrame, steps: DataFrame, snapshots: DataFrame, values: list[str]) -> DataFrame:
    """For each transaction the means over its addresses of their latest ``values`` strictly before its step, 0 without any,
    whether there is any, and the share of addresses that have one. All values travel in one as-of pass. ``membership`` may repeat rows. Rows
    are dealt by their number, so that no task grows with the tables, and none are gathered before they travel, as nearly all differ."""
    parts = parts_for(membership.count())
    own = membership.select("tx_id", "address").repartition(parts, "tx_id").distinct()
    events = materialise(own.join(steps.select("tx_id", "step").repartition(parts, "tx_id"), "tx_id").select("tx_id", "address", "step"), "events")
    seen = asof_prior_snapshot(events, snapshots.select("address", "step", F.struct(*values).alias("_all")), "address", "step", "_all", ["tx_id"], parts=parts)
    seen = seen.select("tx_id", "prior_value").repartition(parts, "tx_id")
    means = [F.coalesce(F.avg(F.col("prior_value")[v]), F.lit(0.0)).alias(f"lag_mean_{v}") for v in values]
    return seen.groupBy("tx_id").agg(*means, (F.count("prior_value") > 0).cast("int").alias("has_history"), (F.count("prior_value") / F.count("*")).alias("share"))


def projected_edges(membership: DataFrame, steps: DataFrame, rows_back: int = 5, most_steps: int = 5) -> DataFrame:
    """From an earlier to a later transaction that share an address, 0 < steps apart <= ``most_steps``, among the
    ``rows_back`` previous membership rows of the address: lags, never pairs of a group."""
    own = membership.select("tx_id", "address").distinct().join(steps.select("tx_id", "step"), "tx_id").withColumn("row", F.struct("tx_id", "step"))
    lagged = lag_k(own, "address", ["step", "tx_id"], "row", list(range(1, rows_back + 1)))
    pairs = lagged.select("tx_id", "step", F.explode(F.array(*[f"row_lag{k}" for k in range(1, rows_back + 1)])).alias("p")).where("p IS NOT NULL")
    gap = F.col("step") - F.col("p.step")
    return pairs.where((gap > 0) & (gap <= most_steps)).select(F.col("p.tx_id").alias("tx_id1"), F.col("tx_id").alias("tx_id2")).distinct()


def wallet_lifespan(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("address").agg(F.min("step").alias("first_step"), F.max("step").alias("last_step"), F.countDistinct("step").alias("steps")).withColumn("span", F.expr("last_step - first_step"))


def ego_subgraph(edges: DataFrame, src: str, dst: str, start: DataFrame, hops: int) -> DataFrame:
    """(node, hop): nodes within ``hops`` undirected edges of the start nodes, with their distance."""
    both = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).union(edges.select(F.col(dst), F.col(src))).distinct()
    reached = start.select(F.col(start.columns[0]).alias("node"), F.lit(0).alias("hop")).distinct()
    frontier = reached
    for hop in range(1, hops + 1):
        following = both.join(frontier.select(F.col("node").alias("a")), "a").select(F.col("b").alias("node")).distinct()
        frontier = following.join(reached, "node", "left_anti").withColumn("hop", F.lit(hop))
        reached = reached.unionByName(frontier)
    return reached


def neighbour_mean(edges: DataFrame, features: DataFrame, src: str, dst: str, node: str, columns: list[str]) -> DataFrame:
    """Mean of each feature over the sources of a node's edges, self-loops and repeats counted as they stand."""
    f = features.select(F.col(node).alias(src), *columns)
    return edges.join(f, src).groupBy(F.col(dst).alias(node)).agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])


def component_time_span(components: DataFrame, steps: DataFrame, node: str, step: str = "step") -> DataFrame:
    """Steps and size of each component, and the share of all components that stay within one step."""
    by = components.join(steps.select(node, step), node).groupBy("component").agg(F.countDistinct(step).alias("steps"), F.min(step).alias("first_step"), F.max(step).alias("last_step"), F.count("*").alias("size"))
    share = by.agg((100.0 * F.count_if(F.col("steps") == 1) / F.count("*")).alias("one_step_percent"))
    return by.crossJoin(F.broadcast(share))  # one row


def cumulative_components(components: DataFrame, steps: DataFrame, node: str, step: str = "step") -> DataFrame:
    """Components of the graph up to each step, where every edge is inside one step: each counts from its own step on."""
    by = components.join(steps.select(node, step), node).groupBy("component").agg(F.min(step).alias(step))
    per = by.groupBy(step).agg(F.count("*").alias("touched"))
    return per.withColumn("components", F.sum("touched").over(Window.orderBy(step)))


def graph_drift_by_step(tx: DataFrame, edges: DataFrame, membership: DataFrame, first: DataFrame, features: list[str], train_last: int, tx_id: str = "tx_id") -> DataFrame:
    """Per step: transactions and edges so far, mean degree, active, new and recurring addresses, the share of transactions
    that have an address seen before, and how far the features' means lie from those of the training steps, as the root of the mean square
    in their deviations."""
    n = tx.groupBy("step").agg(F.count("*").alias("nodes"))
    e = edges.join(tx.select(F.col(tx_id).alias("tx_id1"), "step"), "tx_id1").groupBy("step").agg(F.count("*").alias("edges"))
    a = membership.select(tx_id, "address").join(tx.select(tx_id, "step"), tx_id).select("address", "step").distinct().join(first, "address")
    a = a.groupBy("step").agg(F.count("*").alias("active"), F.count_if(F.expr("first_step = step")).alias("new"), F.count_if(F.expr("first_step < step")).alias("recurring"))
    w = Window.orderBy("step")
    out = n.join(e, "step", "left").join(a, "step", "left").fillna(0)
    out = out.withColumn("cumulative_nodes", F.sum("nodes").over(w)).withColumn("cumulative_edges", F.sum("edges").over(w))
    known = membership.select(tx_id, "address").join(first, "address").join(tx.select(tx_id, "step"), tx_id).groupBy(tx_id, "step").agg(F.max(F.expr("first_step < step").cast("int")).alias("known"))
    context = known.groupBy("step").agg(F.sum("known").alias("with_context"))
    base = tx.where(F.col("step") <= train_last).agg(*[f(c).alias(f"_{a}_{c}") for c in features for a, f in (("m", F.avg), ("s", F.stddev_pop))])
    moved = tx.groupBy("step").agg(*[F.avg(c).alias(c) for c in features]).crossJoin(F.broadcast(base))  # one row
    gaps = sum((F.pow((F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}"), 2) for c in features), F.lit(0.0))
    out = out.join(context, "step", "left").fillna(0, ["with_context"]).join(moved.select("step", F.sqrt(gaps / len(features)).alias("shift_l2")), "step")
    return out.withColumn("context_share", F.col("with_context") / F.col("nodes")).withColumn("mean_degree", 2 * F.col("cumulative_edges") / F.col("cumulative_nodes"))
