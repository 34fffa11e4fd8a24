"""Positions and running sums over a whole ordered table, at two levels: ranges of the order and rows within a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steplens.sources.scratch import materialise

#: ``monotonically_increasing_id`` holds the partition above these bits and the row of the partition below them.
_ROW_BITS = 33


def ranged(df: DataFrame, *order: Column, name: str = "ranged") -> DataFrame:
    """``df`` written in the given order, with ``_range``, the range of the order that a row fell into, and ``_row``, its place
    there from 0. Ranges have about as many rows each, also where many rows tie."""
    dealt = df.withColumn("_tie", F.rand(7))
    keys = [*order, F.col("_tie")]
    placed = dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie").withColumn("_at", F.monotonically_increasing_id())
    written = materialise(placed, name)
    return written.withColumns({"_range": F.shiftright("_at", _ROW_BITS), "_row": F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1)}).drop("_at")


def _carried(written: DataFrame, by: list[str], sums: dict[str, Column]) -> DataFrame:
    """(by, _range, a sum for each name): what the ranges before a range hold of each group; a row for each range and each group."""
    totals = written.groupBy(*by, "_range").agg(*[F.sum(v).alias(f"_{n}") for n, v in sums.items()])
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*by, "_range", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in sums])


def running(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column], name: str = "ranged") -> DataFrame:
    """``df`` with running sums of each group of ``by`` in the given order, each row included; ties count one after the other.

    No window is larger than a range, whatever a group holds: totals of ranges are carried, rows are summed inside them. Groups are
    told apart with nulls as values."""
    written = ranged(df, *[F.col(c) for c in by], *order, name=name)
    carried = materialise(_carried(written, by, sums), f"{name}-carried")
    within = Window.partitionBy(*by, "_range").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    summed = written.withColumns({f"_own_{n}": F.sum(v).over(within) for n, v in sums.items()})
    keys = [summed[c].eqNullSafe(carried[c]) for c in [*by, "_range"]]
    found = summed.join(carried, keys, "left")
    return found.select(*[summed[c] for c in df.columns], *[(F.col(f"_own_{n}") + F.col(f"_before_{n}")).alias(n) for n in sums])


def positions(df: DataFrame, by: list[str], order: list[Column], index: str, size: str, name: str = "ranged") -> DataFrame:
    """``df`` with the place ``index``, from 0, of each row in its group of ``by`` and the ``size`` of the group. Rows that tie in
    ``by`` and ``order`` get places of their own in any order. No window over rows: places in a range are known as it is written."""
    written = ranged(df, *[F.col(c).asc_nulls_first() for c in by], *order, name=name)
    spans = written.groupBy(*by, "_range").agg(F.min("_row").alias("_from"), F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*by)
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_from")
    spans = materialise(spans.select(*by, "_range", base.alias("_base"), F.sum("_n").over(group).alias(size)), f"{name}-spans")
    found = written.join(spans, [written[c].eqNullSafe(spans[c]) for c in [*by, "_range"]])
    return found.select(*[written[c] for c in df.columns], (F.col("_base") + F.col("_row")).alias(index), spans[size])


#: Ranges of values that a group is cut into.
RANGES = 256


def keyed_join(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right``, whose keys count nulls as values; without keys ``right`` is one row."""
    if not by:
        return left.crossJoin(F.broadcast(right))
    other = right.withColumnsRenamed({c: f"_key_{c}" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in by]
    return left.join(other, same, how).drop(*[f"_key_{c}" for c in by])


def reached(edges: str, ranges: int, value: str) -> Column:
    """How many of up to ``ranges`` - 1 ascending edges are no greater than the value, found by halving; ``ranges`` is a power of two."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(ranges.bit_length() - 1))])
    return F.aggregate(steps, F.lit(0), lambda i, s: i + F.when(F.get(edges, i + s - 1) <= F.col(value), s).otherwise(F.lit(0)))


def value_edges(df: DataFrame, by: list[str], value: str, ranges: int = RANGES) -> DataFrame:
    """(by, _edges): values that cut each group into ranges of about as many rows."""
    return df.groupBy(*by).agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 4 * ranges).alias("_edges"))


def running_by_value(df: DataFrame, by: list[str], value: str, sums: list[str], descending: bool = False, ranges: int = RANGES, edges: DataFrame | None = None) -> DataFrame:
    """``df`` with ``run_`` and ``all_`` of each of ``sums``: its sum in the group of ``by`` over the rows up to this one in the order of
    ``value``, which is distinct in a group, and over the whole group.

    A sketch of each group cuts its values into ranges of about as many rows. Totals of ranges are carried from one to the next,
    and only the rows of a range meet in a window, so a large group is spread over all tasks. ``edges``, one row for all groups, may
    come from elsewhere where groups are alike.

    A sketch depends on the order in which its parts arrive, which differs from one reading of a shuffle to the next. Rows are
    written with their ranges, so that totals and windows go by the same ones."""
    dealt = keyed_join(df, edges, []) if edges is not None else keyed_join(df, value_edges(df, by, value, ranges), by)
    dealt = materialise(dealt.withColumn("_range", reached("_edges", ranges, value)).drop("_edges"), "by-value")
    order = F.desc if descending else F.asc
    before = Window.partitionBy(*by).orderBy(order("_range")).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_sum_{c}") for c in sums])
    carried = totals.select(*by, "_range", *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in sums], *[F.sum(f"_sum_{c}").over(Window.partitionBy(*by)).alias(f"all_{c}") for c in sums])
    within = Window.partitionBy(*by, "_range").orderBy(order(value)).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumns({f"_own_{c}": F.sum(c).over(within) for c in sums})
    found = keyed_join(summed, carried, [*by, "_range"])
    return found.select(*df.columns, *[(F.col(f"_own_{c}") + F.col(f"_before_{c}")).alias(f"run_{c}") for c in sums], *[f"all_{c}" for c in sums])


#: One over the rank error of the sketch that brackets quantiles, as a share of a group.
ACCURACY = 10_000


def quantiles(df: DataFrame, by: list[str], value: str, probs: list[float], name: str = "quantiles", accuracy: int = ACCURACY) -> DataFrame:
    """(by, name): exact quantiles of each group by linear interpolation between neighbours, as an array; null values do not count.

    A sketch whose rank error is bounded brackets each quantile. A second pass counts the rows below each bracket and gathers the
    values inside it, a few of ``accuracy`` rows; the two neighbours are found among these by their ranks. The sketch is written, so
    that both sides of a bracket go by the same one."""
    given = df.where(F.col(value).isNotNull())
    wide = 3 / accuracy
    at = [p for q in probs for p in (max(0.0, q - wide), min(1.0, q + wide))]
    sketch = given.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx(value, at, accuracy).alias("_b"))
    own = keyed_join(given.select(*by, F.col(value).alias("_v")), materialise(sketch, f"{name}-sketch"), by)
    low, high = ([F.get("_b", F.lit(2 * k + e)) for k in range(len(probs))] for e in (0, 1))
    below = own.groupBy(*by).agg(
        F.max("_n").alias("_n"), F.array(*[F.count_if(F.col("_v") < x) for x in low]).alias("_below"),
        F.array(*[F.max(F.when(F.col("_v") < x, F.col("_v"))) for x in low]).alias("_under"), F.array(*[F.min(F.when(F.col("_v") > x, F.col("_v"))) for x in high]).alias("_over"),
    )
    brackets = F.array(*[F.when((F.col("_v") >= x) & (F.col("_v") <= y), F.lit(k)) for k, (x, y) in enumerate(zip(low, high, strict=True))])
    inside = own.select(*by, "_v", F.explode(F.filter(brackets, lambda k: k.isNotNull())).alias("_k")).groupBy(*by, "_k", "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*by, "_k").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = keyed_join(inside.withColumn("_upto", upto), below, by).withColumn("_upto", F.col("_upto") + F.get("_below", F.col("_k")))
    rank = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("_k") + 1) * (F.col("_n") - 1)
    ranked = ranked.select(*by, "_k", "_v", "_upto", rank.alias("_rank"), *[F.get(c, F.col("_k")).alias(c) for c in ("_below", "_under", "_over")])
    found = ranked.groupBy(*by, "_k", "_rank", "_below", "_under", "_over").agg(F.max("_upto").alias("_end"), *[F.min(F.when(F.col("_upto") > f(F.col("_rank")), F.col("_v"))).alias(a) for f, a in ((F.floor, "_lo"), (F.ceil, "_hi"))])
    # a neighbour may be the value next to the bracket, where a group has few rows
    for f, a in ((F.floor, "_lo"), (F.ceil, "_hi")):
        r = f(F.col("_rank"))
        found = found.withColumn(a, F.when(r == F.col("_below") - 1, F.col("_under")).when(r == F.col("_end"), F.col("_over")).when(r >= F.col("_below"), F.col(a)))
    between = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise((F.ceil("_rank") - F.col("_rank")) * F.col("_lo") + (F.col("_rank") - F.floor("_rank")) * F.col("_hi"))
    missed = F.raise_error(F.lit("a quantile lies outside its bracket"))
    found = found.withColumn("_q", F.when(F.col("_lo").isNull() | F.col("_hi").isNull(), missed.cast("double")).otherwise(between))
    return found.groupBy(*by).agg(F.array(*[F.max(F.when(F.col("_k") == k, F.col("_q"))) for k in range(len(probs))]).alias(name))
