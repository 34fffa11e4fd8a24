"""Connected components by alternating star contraction (Kiveris et al., SoCC 2014)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steplens.sources.scratch import mark, materialise, release


def _keyed_minimum(edges: DataFrame, smallest: Column) -> DataFrame:
    """Each edge (u, v) with the least neighbour of u. The minima are pre-aggregated on the map side, written, and joined
    back: a hub is one short row on that side, and as both sides of the join are dealt out for it alone, Spark may split
    the hub's edges."""
    return edges.join(materialise(edges.groupBy("u").agg(smallest.alias("m")), "minima"), "u")


#: Rounds of peeling at most, and the share of the edges that a round must take away for another one.
PEELS, PEELED = 6, 0.1


def _peel(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges without leaves, leaves): edges (u, v), u > v, whose nodes u that no edge has as its v are taken out with (u, m), the
    least v of each: it is in the component of m, and its other neighbours are joined to m in its place."""
    minima = materialise(edges.groupBy("u").agg(F.min("v").alias("m")), "minima")
    inner = edges.select(F.col("v").alias("u")).distinct()
    leaves = materialise(minima.join(inner, "u", "left_anti"), "leaves")
    around = edges.join(minima, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    kept = minima.join(inner, "u", "left_semi").select("u", F.col("m").alias("v"))
    return materialise(around.unionByName(kept).distinct(), "peeled"), leaves


def _with_leaves(found: list[DataFrame], peeled: list[DataFrame], loops: DataFrame) -> DataFrame:
    """(node, component) of what is found, of the leaves, those peeled last first, and of loops. What a leaf was joined to and is in no
    edge any more is its own component."""
    for leaves in reversed(peeled):
        known = reduce(DataFrame.unionByName, found).groupBy("node").agg(F.min("component").alias("component"))
        placed = materialise(leaves.join(known, leaves["m"] == known["node"], "left").select("u", "m", "component"), "placed")
        alone = placed.where("component is null").select("m").distinct()
        found = [*found, placed.select(F.col("u").alias("node"), F.coalesce("component", "m").alias("component")), alone.select(F.col("m").alias("node"), F.col("m").alias("component"))]
    found = [*found, loops.select("node", F.col("node").alias("component"))]
    return reduce(DataFrame.unionByName, found).groupBy("node").agg(F.min("component").alias("component"))


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every end of ``edges``; component is the smallest node reached, itself included.

    Edges have no direction. Self-loops keep their node, null ends are dropped, repeated edges count once, and no edges
    give no rows. Each round contracts every neighbourhood onto its least node and is written out, so the lineage stays
    short and hubs cost one row per edge, never pairs. Leaves are peeled off first, as long as that takes edges away, and
    take the component of their neighbour at the end.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    given = materialise(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    loops = given.where("u = v").select(F.col("u").alias("node"))
    stars, spark, peeled, whole = given.where("u <> v"), edges.sparkSession, [], mark(edges.sparkSession)
    size = stars.count()
    for _ in range(PEELS):
        if not size:
            break
        begun = mark(spark)
        stars, leaves = _peel(stars)
        peeled.append(leaves)
        release(spark, begun, begun + 1)  # the minima
        release(spark, max(whole, begun - 1), begun)  # the edges before
        had, size = size, stars.count()
        if size > (1 - PEELED) * had:
            break
    check = (F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u")))
    before, last = stars.agg(*check).first(), mark(spark)
    for _ in range(max_rounds if size else 0):
        begun = mark(spark)
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _keyed_minimum(both, F.least(F.min("u"), F.min("v"))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _keyed_minimum(large, F.min("v"))
        stars = small.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        stars = materialise(stars.select("e.u", "e.v").where("u <> v").distinct(), "stars")
        release(spark, last, begun)  # the round before, now that its successor is written
        last = begun
        after = stars.agg(*check).first()
        if after == before:
            break
        before = after
    else:
        if size:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")))
    return _with_leaves([found], peeled, loops)
