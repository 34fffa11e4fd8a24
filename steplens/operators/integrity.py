"""Keys, duplicates, reconciliation of tables, and rules over what they show."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")


def key_uniqueness(df: DataFrame, key: str) -> DataFrame:
    """rows, distinct ids, duplicates and blank ids, in one pass after one grouping by the key."""
    by_key = df.select(key).groupBy(key).agg(F.count("*").alias("n"))
    return by_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count_if(~_blank(key)).alias("distinct_ids"),
        F.coalesce(F.sum(F.when(~_blank(key), F.col("n") - 1)), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum(F.when(_blank(key), F.col("n"))), F.lit(0)).alias("blank_ids"),
    )


def cell_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """Blank, non-numeric and NaN cells of each column of strings: one wide aggregate, then one row a column."""
    counts = []
    for c in columns:
        number = F.col(c).cast("string").try_cast("double")
        counts.append(F.struct(F.lit(c).alias("column"), F.count_if(_blank(c)).alias("blank"), F.count_if(~_blank(c) & number.isNull()).alias("non_numeric"), F.count_if(F.isnan(number)).alias("nan")))
    return df.agg(F.array(*counts).alias("a")).select(F.explode("a").alias("a")).select("a.*")


def class_domain(df: DataFrame, cls: str, allowed: list[int]) -> DataFrame:
    """Rows of each class, and whether the class is allowed."""
    return df.groupBy(cls).agg(F.count("*").alias("n")).withColumn("allowed", F.coalesce(F.col(cls).isin(*allowed), F.lit(False)))


def step_domain(df: DataFrame, step: str, last: int) -> DataFrame:
    """min, max, distinct steps, rows outside 1..last, and whether 1..last is complete."""
    by_step = df.groupBy(step).agg(F.count("*").alias("n"))
    inside = F.col(step).between(1, last)
    return by_step.agg(F.min(step).alias("first"), F.max(step).alias("last"), F.count(step).alias("distinct_steps"), F.coalesce(F.sum(F.when(~F.coalesce(inside, F.lit(False)), F.col("n"))), F.lit(0)).alias("invalid_rows"), (F.count_if(inside) == last).alias("contiguous"))


def snapshot_dedup(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in an explicit order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def dup_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs that occur more than once, the rows beyond the first, and the most rows of one ``a``."""
    pairs = df.groupBy(a, b).agg(F.count("*").alias("n"))
    by_a = pairs.groupBy(a).agg(F.sum("n").alias("rows"), F.count_if(F.col("n") > 1).alias("dup"), F.sum(F.col("n") - 1).alias("extra"))
    return by_a.agg(F.sum("dup").alias("duplicate_pairs"), F.sum("extra").alias("extra_rows"), F.max("rows").alias("max_rows_per_key"))


def declared_vs_observed(df: DataFrame, key: str, declared: str) -> DataFrame:
    """Keys whose declared counts conflict, and keys whose row count differs from the declared one."""
    by_key = df.groupBy(key).agg(F.min(declared).alias("lo"), F.max(declared).alias("hi"), F.count("*").alias("n"))
    return by_key.agg(F.count("*").alias("keys"), F.count_if(F.col("lo") != F.col("hi")).alias("conflicting"), F.count_if(F.col("n") != F.col("hi")).alias("count_differs"))


def class_mismatch(df: DataFrame, lookup: DataFrame, key: str, cls: str, lookup_cls: str) -> DataFrame:
    """Rows whose key the lookup does not know, and rows whose class differs there."""
    joined = df.select(key, cls).join(lookup.select(key, F.col(lookup_cls).alias("_cls"), F.lit(1).alias("_in")), key, "left")
    return joined.agg(F.count("*").alias("rows"), F.count_if(F.col("_in").isNull()).alias("missing"), F.count_if(F.col("_in").isNotNull() & ~F.col(cls).eqNullSafe(F.col("_cls"))).alias("different"))


def edge_audit(edges: DataFrame, src: str, dst: str, src_universe: DataFrame, dst_universe: DataFrame) -> DataFrame:
    """Edges, distinct pairs, duplicates, self-loops, blank ends, distinct ends and those outside their universes, and distinct
    nodes of both sides together."""
    pairs = edges.groupBy(src, dst).agg(F.count("*").alias("n"))
    base = pairs.agg(F.sum("n").alias("edges"), F.count("*").alias("unique_edges"), F.sum(F.when(F.col(src).cast("string") == F.col(dst).cast("string"), F.col("n")).otherwise(0)).alias("self_loops"), F.sum(F.when(_blank(src) | _blank(dst), F.col("n")).otherwise(0)).alias("blank_ends"))

    def ends(c: str, universe: DataFrame, name: str) -> DataFrame:
        u = universe.select(F.col(universe.columns[0]).alias(c)).distinct().withColumn("_in", F.lit(1))
        return edges.select(c).distinct().join(u, c, "left").agg(F.count("*").alias(f"unique_{name}"), F.count_if(F.col("_in").isNull()).alias(f"{name}_outside"))

    nodes = edges.select(F.explode(F.array(F.col(src).cast("string"), F.col(dst).cast("string"))).alias("n")).distinct().agg(F.count("n").alias("unique_nodes"))
    out = base.crossJoin(ends(src, src_universe, "src")).crossJoin(ends(dst, dst_universe, "dst")).crossJoin(nodes)  # one row each
    return out.withColumn("duplicates", F.col("edges") - F.col("unique_edges"))


def cross_reference(sets: dict[str, DataFrame]) -> DataFrame:
    """Sizes of every set and of both differences and the intersection of every two, from one grouping by id."""
    names = list(sets)
    tagged = reduce(DataFrame.unionByName, [df.select(F.col(df.columns[0]).cast("string").alias("id"), F.lit(1 << i).alias("bit")) for i, df in enumerate(sets.values())])
    masks = tagged.groupBy("id").agg(F.bit_or("bit").alias("mask")).groupBy("mask").agg(F.count("*").alias("n"))
    bit = lambda i: F.col("mask").bitwiseAND(1 << i) != 0
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    found = [F.struct(F.lit(f"size:{a}").alias("name"), total(bit(i)).alias("n")) for i, a in enumerate(names)]
    for i, a in enumerate(names):
        for j in range(i + 1, len(names)):
            b = names[j]
            for label, cond in ((f"both:{a}:{b}", bit(i) & bit(j)), (f"only:{a}:{b}", bit(i) & ~bit(j)), (f"only:{b}:{a}", bit(j) & ~bit(i))):
                found.append(F.struct(F.lit(label).alias("name"), total(cond).alias("n")))
    return masks.agg(F.array(*found).alias("f")).select(F.explode("f").alias("f")).select("f.*")


def sets_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether two one-column tables hold the same ids, and how many only one of them holds."""
    x, y = a.select(F.col(a.columns[0]).alias("id")).distinct(), b.select(F.col(b.columns[0]).alias("id")).distinct()
    sides = x.select("id", F.lit(1).alias("s")).unionByName(y.select("id", F.lit(2).alias("s"))).groupBy("id").agg(F.sum("s").alias("s"))
    return sides.agg(F.count_if(F.col("s") == 1).alias("only_left"), F.count_if(F.col("s") == 2).alias("only_right")).withColumn("equal", F.expr("only_left = 0 AND only_right = 0"))


def integrity_rules(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules (name, op, bound, kind) that a table of metrics (name, n) breaks; a metric that is missing breaks its rule."""
    joined = rules.join(metrics, "name", "left")
    holds = F.when(F.col("op") == "=", F.col("n") == F.col("bound")).when(F.col("op") == "<=", F.col("n") <= F.col("bound")).when(F.col("op") == ">=", F.col("n") >= F.col("bound"))
    return joined.where(~F.coalesce(holds, F.lit(False))).select("name", "kind", "n", "bound")


def assert_sound(broken: DataFrame) -> None:
    """Fail with the first broken rules, of which there are no more than rules."""
    if found := broken.where("kind = 'failure'").limit(20).collect():
        raise ValueError(f"integrity rules broken: {[tuple(r) for r in found]}")
