"""Merkle manifest of a dataset: one tree for each source over its documents, one over the sources, with a proof for each
document. Lag and lead windows at fixed offsets find siblings; the first row of each run carries its parent's hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steplens.operators.prefix import positions
from steplens.sources.scratch import materialise

#: Nodes that share a parent, and levels that one pass of windows climbs: a window holds FAN ** LEVELS rows at most.
FAN, LEVELS = 3, 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of strings end to end."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the value's UTF-8 bytes behind their number."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: Sequence[Column]) -> Column:
    return digest(*[field(c) for c in fields])


def _height(count: Column) -> Column:
    """Levels above the leaves until one node is left: the least t with FAN ** t >= count."""
    height = F.lit(0)
    for t in range(39):
        height = F.when(count > FAN**t, F.lit(t + 1)).otherwise(height)
    return height


def climb(nodes: DataFrame, level: int) -> DataFrame:
    """``nodes`` (g, i, n, h) of one level, i places in groups of n leaves, with what they meet on the next ``LEVELS`` levels: ``steps``, one
    (left, right) of its ancestor's siblings for each level below the group's root, and ``h``, on the first row of a block its
    ancestor's hash.

    All rows of a block of FAN ** LEVELS nodes stay in order in one window. At step t the rows whose place FAN ** t divides hold the
    nodes, so siblings stand at that offset, and slot and run length tell which of them exist."""
    size = FAN**LEVELS
    block = Window.partitionBy("g", "b").orderBy("i")
    found = nodes.withColumn("b", F.floor(F.col("i") / size)).withColumn("height", _height(F.col("n")))
    names = []
    for t in range(LEVELS):
        far, up = FAN**t, level + t
        near = [*range(-FAN + 1, 0), *range(1, FAN)]
        found = found.withColumns({f"at{d}": F.lag("h", -d * far).over(block) if d < 0 else F.lead("h", d * far).over(block) for d in near})
        place = F.floor(F.col("i") / far)
        slot, first = F.pmod(place, F.lit(FAN)), F.col("i") % far == 0
        count = F.ceil(F.col("n") / F.lit(FAN**up))
        run = F.least(F.lit(FAN).cast("long"), count - (place - slot))
        left = F.concat(*[F.when(slot >= -d, F.col(f"at{d}")).otherwise(F.lit("")) for d in near if d < 0])
        right = F.concat(*[F.when(slot + d < run, F.col(f"at{d}")).otherwise(F.lit("")) for d in near if d > 0])
        below = F.lit(up) < F.col("height")
        step = F.when(first & below, F.struct(left.alias("left"), right.alias("right")))
        parent = F.when(below, digest(F.col("h"), right)).otherwise(F.col("h"))
        found = found.withColumns({f"step{t}": step, "next": F.when(F.col("i") % (far * FAN) == 0, parent)})
        found = found.withColumn("h", F.col("next")).drop("next", *[f"at{d}" for d in near])
        names.append(f"step{t}")
    own = block.rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumns({s: F.last(s, ignorenulls=True).over(own) for s in names})
    return found.withColumn("steps", F.filter(F.array(*names), lambda s: s.isNotNull())).drop(*names, "height")


def tree(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From leaves (g, i, n, h, ...): their rows with ``steps``, all siblings from the leaf up as (left, right) of each level, and the roots
    (g, root). Passes follow until no group has more than one node, so their number is the logarithm of the largest."""
    extra = [c for c in nodes.columns if c not in ("g", "i", "n", "h")]
    passes, level = [], 0
    largest = nodes.agg(F.max("n")).first()[0] or 0
    while not passes or largest > FAN**level:
        # what a window needs and no more, but on the first pass the leaves' own columns
        passes.append(materialise(climb(nodes.withColumn("leaf", F.col("h")) if not passes else nodes, level), "merkle"))
        nodes, level = passes[-1].where("h is not null").select("g", F.col("b").alias("i"), "n", "h"), level + LEVELS
    roots = materialise(nodes.select("g", F.col("h").alias("root")), "roots")
    above = None
    for done in reversed(passes):
        kept = ["g", "i", "b", "steps"] + (["leaf", *extra] if done is passes[0] else [])
        own = done.select(*kept)
        if above is not None:
            up = above.select(F.col("g").alias("_g"), F.col("i").alias("_i"), F.col("steps").alias("_steps"))
            own = own.join(up, own["g"].eqNullSafe(up["_g"]) & (own["b"] == up["_i"]))
            own = own.withColumn("steps", F.concat("steps", "_steps")).drop("_g", "_i", "_steps")
        above = own
    return above.drop("i", "b"), roots


def fold(start: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(steps, start, lambda h, s: digest(s["left"], h, s["right"]))


def proof(steps: Column) -> Column:
    """All siblings from the leaf up, left to right, end to end."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), "")


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, steps, arrived) for every row of ``docs``: its leaf, the roots above it, its siblings on every level
    up to the dataset's root, and the leaf of what has arrived: of the text ``tampered``, if given, else of the row itself.

    Documents stand in their source by doc_id, null first; rows alike in doc_id stand by their leaves, rows alike in all in any
    order. A null field is told apart from an empty one. A source of one document has its leaf for a root, a dataset of one
    source that source's. An empty table gives an empty one."""
    same = [F.col(c) for c in FIELDS]
    now = same[:-1] + [tampered if tampered is not None else same[-1]]
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("g"), leaf(same).alias("h"), leaf(now).alias("arrived"))
    placed = positions(materialise(found, "leaves"), ["g"], [F.col("doc_id").asc_nulls_first(), F.col("h")], "i", "n", "leaves-placed")
    leaves, subroots = tree(placed)
    sources = positions(subroots.withColumnRenamed("root", "h").withColumn("all", F.lit(0)), ["all"], [F.col("g").asc_nulls_first()], "i", "n", "sources-placed")
    tops, roots = tree(sources.select(F.col("all").alias("g"), "i", "n", "h", F.col("g").alias("source")))
    tops = tops.crossJoin(F.broadcast(roots.select("root")))  # one root
    tops = materialise(tops.select("source", F.col("leaf").alias("subroot"), "root", F.col("steps").alias("above")), "subroots")
    both = leaves.join(tops, leaves["g"].eqNullSafe(tops["source"]))
    return both.select("doc_id", "leaf", "subroot", "root", F.concat("steps", "above").alias("steps"), "arrived")


def verify(found: DataFrame) -> DataFrame:
    """``manifest`` rows with the root that each arrived leaf gives with its siblings, and whether that is the dataset's."""
    return found.withColumn("folded_root", fold(F.col("arrived"), F.col("steps"))).withColumn("verified", F.col("folded_root") == F.col("root"))
