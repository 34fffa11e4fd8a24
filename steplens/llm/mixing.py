"""Mixing sources to target shares of words: whole epochs of each source, then documents by Efraimidis-Spirakis keys up to what
is left of its budget. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steplens.operators.prefix import positions, running
from steplens.sources.scratch import materialise

#: Shares of the sources in their order, repeating, and how often a source may be taken at most.
SHARES, MOST_EPOCHS = (5, 2, 1), 3
#: Rows of a source that one bucket of its keys holds at about most, and buckets of a source at least and at most.
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 65_536, 1024, 1 << 20
#: The greatest weight that the quality of a document gives; the least is 1.
MOST_WEIGHT = 8
_SPACES = r"[\x20\x09-\x0D]+"
_PLAIN = r"^\p{L}+\p{P}?\z"


def text_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPACES), lambda w: w != "")


def measured(text: Column) -> Column:
    """(size, weight) of a text: its number of words, and 1 to ``MOST_WEIGHT`` by the share of them that are letters with one mark
    of punctuation behind at most. Null and empty texts: 0 and 1."""

    def of(words: Column) -> Column:
        n, plain = F.size(words), F.size(F.filter(words, lambda w: w.rlike(_PLAIN)))
        share = F.when(n > 0, plain / n).otherwise(F.lit(0.0))
        return F.struct(n.cast("long").alias("size"), (1 + (MOST_WEIGHT - 1) * share).alias("weight"))

    return F.get(F.transform(F.array(text_words(text)), of), F.lit(0))


def keyed(docs: DataFrame, size: Column | None = None, weight: Column | None = None, with_text: bool = False) -> DataFrame:
    """(doc_id, source, size, key, tie[, text]) of every row, size and weight as ``measured`` if not given. The key is an exponential
    variable over the weight: the least keys are taken first, and a document of twice the weight is twice as likely to be the next.
    It comes from a digest of doc_id and text, so reruns agree, and rows alike in both have the same one. Weights that are null,
    not finite or not above 0 count as 1, null sizes as 0."""
    tie = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce("text", F.lit(""))))
    m = measured(F.col("text"))
    given = F.struct((m["size"] if size is None else size).cast("long").alias("size"), (m["weight"] if weight is None else weight).cast("double").alias("weight"))
    own = [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source")]
    found = docs.select(*own, (m if size is None and weight is None else given).alias("m"), tie.alias("tie"), "text")
    w = F.col("m.weight")
    uniform = (F.conv(F.substring("tie", 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    key = -F.log(uniform) / F.when(w.isNotNull() & ~F.isnan(w) & (w > 0) & (w < float("inf")), w).otherwise(F.lit(1.0))
    return found.select("doc_id", "source", F.coalesce("m.size", F.lit(0).cast("long")).alias("size"), key.alias("key"), "tie", *["text"] * with_text)


def targets(sources: DataFrame, shares: Sequence[int] = SHARES, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target): sources by code point, null last, weigh ``shares``, repeating, and share all sizes by weight. A
    target stops at ``most_epochs`` times its source's size; what is above is shared by weight among the others until none is.

    Where the capped sources are known, all others stand at one level, words for each unit of weight. Sources are capped in
    the order of size for each unit of weight, so running sums in that order give the level after each, and the first source
    that the level does not fill has the right one."""
    placed = positions(sources, [], [F.col("source").asc_nulls_last()], "place", "n", "sources")
    weight = F.element_at(F.array(*[F.lit(s).cast("long") for s in shares]), (F.col("place") % len(shares) + 1).cast("int"))
    cap = F.col("source_size") * most_epochs
    weighed = placed.select("source", "source_size", weight.alias("weight"), cap.alias("cap"))
    order = [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()]
    rising = materialise(running(weighed, [], order, {"caps": F.col("cap"), "weights": F.col("weight")}, "caps"), "levels")
    total = rising.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("all"))
    left, heavy = F.col("total") - (F.col("caps") - F.col("cap")), F.col("all") - (F.col("weights") - F.col("weight"))
    fills = rising.crossJoin(F.broadcast(total)).where(left * F.col("weight").cast("double") <= F.col("cap") * heavy.cast("double"))  # one row of sums
    level = fills.agg(F.min_by(F.struct(left.cast("double").alias("left"), heavy.alias("heavy")), F.struct("caps", "weights")).alias("l"))
    above = F.col("l.left") * F.col("weight") > F.col("cap") * F.col("l.heavy")
    target = F.when(above, F.col("cap").cast("double")).otherwise(F.col("l.left") * F.col("weight") / F.col("l.heavy"))
    return rising.crossJoin(F.broadcast(level)).select("source", "source_size", target.alias("target"))


def plan(rows: DataFrame, shares: Sequence[int] = SHARES, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """One row for each source of ``keyed`` rows: (source, source_size, target, epochs, last_key, last_tie, cut).

    Every document is taken ``epochs`` times; those before (last_key, last_tie) in the order of keys once more; of those at
    that place, the first ``cut`` words. The order is summed at two levels: buckets of keys first, then the rows of the one bucket
    that the budget ends in, where rows with one key count together."""
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, rows.count() // BUCKET_ROWS))
    rows = rows.withColumn("bucket", F.floor((1 - F.exp(-F.col("key"))) * buckets))
    histogram = materialise(rows.groupBy("source", "bucket").agg(F.sum("size").alias("size")), "key-buckets")
    sources = histogram.groupBy("source").agg(F.sum("size").alias("source_size"))
    budgets = targets(sources, shares, most_epochs)
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    budgets = budgets.withColumn("epochs", epochs.cast("long")).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    budgets = materialise(budgets, "budgets")

    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    summed = histogram.withColumn("upto", F.sum("size").over(upto))
    ends = summed.join(budgets.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
    ends = ends.where((F.col("rest") > F.col("upto") - F.col("size")) & (F.col("rest") <= F.col("upto")))
    ends = materialise(ends.select("s", F.col("bucket").alias("b"), (F.col("rest") - F.col("upto") + F.col("size")).alias("rest")), "last-buckets")

    near = rows.join(ends, rows["source"].eqNullSafe(ends["s"]) & (rows["bucket"] == ends["b"]))
    ties = near.groupBy("source", "rest", "key", "tie").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    within = Window.partitionBy("source").orderBy("key", "tie").rowsBetween(Window.unboundedPreceding, 0)
    before = F.col("upto") - F.col("size")
    last = ties.withColumn("upto", F.sum("size").over(within)).where((F.col("rest") > before) & (F.col("rest") <= F.col("upto")))
    last = last.select(F.col("source").alias("s"), F.col("key").alias("last_key"), F.col("tie").alias("last_tie"), F.floor((F.col("rest") - before) / F.col("n")).alias("cut"))
    found = budgets.join(last, budgets["source"].eqNullSafe(last["s"]), "left")
    return materialise(found.select("source", "source_size", "target", "epochs", "last_key", "last_tie", "cut"), "mix-plan")


def taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``keyed`` rows with what their source's plan takes of them: epochs, ``extra`` words in a last copy, and ``taken``, the words of
    all copies. A source without words is taken 0 times."""
    p = plan.withColumnRenamed("source", "_source")
    both = rows.join(p, rows["source"].eqNullSafe(p["_source"])).drop("_source")
    same = F.col("key") == F.col("last_key")
    extra = F.when(same & (F.col("tie") == F.col("last_tie")), F.col("cut"))
    extra = extra.when((F.col("key") < F.col("last_key")) | (same & (F.col("tie") < F.col("last_tie"))), F.col("size")).otherwise(F.lit(0))
    both = both.withColumn("extra", extra.cast("long"))
    return both.withColumn("taken", F.col("epochs") * F.col("size") + F.col("extra")).drop("last_key", "last_tie", "cut")


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, key, tie, source_size, target, epochs, extra, taken) of every row of ``docs``, mixed by words and quality.

    Null and empty texts have size 0; null is a source of its own; rows alike in doc_id, source and text are taken alike; an empty
    table gives an empty one."""
    rows = materialise(keyed(docs), "keys")
    return taken(rows, plan(rows))


def mixed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, source, copy, text): the mix itself, a row for each whole copy of a document, and one for what the last copy takes of
    it: the whole text or its first words joined by single spaces."""
    found = taken(keyed(docs, with_text=True), plan(materialise(keyed(docs), "keys")))
    copies = F.col("epochs") + (F.col("extra") > 0).cast("long")
    rows = found.where((F.col("size") > 0) & (copies > 0)).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    part = F.array_join(F.slice(text_words(F.col("text")), 1, F.col("extra").cast("int")), " ")
    cut = (F.col("copy") > F.col("epochs")) & (F.col("extra") < F.col("size"))
    return rows.select("doc_id", "source", "copy", F.when(cut, part).otherwise(F.col("text")).alias("text"))
