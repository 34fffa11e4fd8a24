"""Repeated runs of lines: content-defined chunks between boundary lines that a rolling hash over line hashes chooses, and
what runs share inside chunks that do not repeat as wholes, removed after byte comparison. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steplens.sources.scratch import materialise

#: One line in so many is no boundary. The rolling hash looks at one line at a time, so that a boundary depends on nothing that a
#: run of two lines does not hold.
SPARSE = 4
_PAIR = "array<struct<a:bigint,b:bigint,c:int>>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body's inner functions name it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _split(text: str) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hash(line: Column) -> tuple[Column, Column]:
    return F.xxhash64(line), F.xxhash64(F.lit(1), line)


def _identity(line: Column, number: Column) -> Column:
    a, b = line_hash(line)
    return F.struct(a.alias("a"), b.alias("b"), number.cast("int").alias("c"))


def hashed(docs: DataFrame) -> DataFrame:
    """(_sl_id, _sl_key, h, full): the hashes of each row's lines, and whether each line has more than white space."""
    lines = docs.select(F.col("doc_id").cast("long").alias("_sl_id"), F.xxhash64("doc_id", "text").alias("_sl_key"), _split("text").alias("lines"))
    return lines.select("_sl_id", "_sl_key", F.transform("lines", lambda x: _identity(x, F.lit(0))).alias("h"), F.transform("lines", lambda x: x.rlike(r"\S")).alias("full"))


def _told_apart(docs: DataFrame, collided: DataFrame) -> DataFrame:
    """``hashed`` with numbers for the lines (a, b, line) of which several share their hashes."""
    numbers = collided.withColumn("c", F.dense_rank().over(Window.partitionBy("a", "b").orderBy("line")))
    lines = docs.select(F.col("doc_id").cast("long").alias("_sl_id"), F.xxhash64("doc_id", "text").alias("_sl_key"), F.posexplode(_split("text")).alias("pos", "line")).distinct()
    a, b = line_hash(F.col("line"))
    joined = lines.select("*", a.alias("a"), b.alias("b")).join(numbers, ["a", "b", "line"], "left")
    one = F.struct("pos", F.struct("a", "b", F.coalesce("c", F.lit(0)).alias("c")).alias("h"), F.col("line").rlike(r"\S").alias("full"))
    rows = joined.groupBy("_sl_id", "_sl_key").agg(F.sort_array(F.collect_list(one)).alias("l"))
    return rows.select("_sl_id", "_sl_key", F.col("l.h").cast(_PAIR).alias("h"), F.col("l.full").alias("full"))


def is_boundary(line: Column) -> Column:
    """Whether a line, by its hashes, ends a chunk and begins the next one."""
    return F.pmod(F.xxhash64(line["a"]), F.lit(SPARSE)) != 0


def chunk_starts(h: Column) -> Column:
    """Places of the boundaries: the first line, the last, and those that the rolling hash chooses wherever their lines stand."""
    return F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: (i == 0) | (i == F.size(h) - 1) | is_boundary(F.get(h, i)))


def _chunks(rows: DataFrame) -> DataFrame:
    """(_sl_id, _sl_key, pos, n, own): the chunks, each from one boundary to the next with both, that are not blank, with their line
    hashes. Two boundaries that follow one another are a chunk of two lines."""
    span = lambda x, at, to: F.slice(x, at + 1, to - at + 1)
    found = lambda s: F.transform(F.slice(s, 1, F.size(s) - 1), lambda at, j: F.struct(at.alias("pos"), span(F.col("h"), at, F.get(s, j + 1)).alias("own"), F.exists(span(F.col("full"), at, F.get(s, j + 1)), lambda x: x).alias("full")))
    out = rows.where(F.size("h") > 1).select("_sl_id", "_sl_key", F.explode(_let(chunk_starts(F.col("h")), found)).alias("x")).where("x.full")
    return out.select("_sl_id", "_sl_key", "x.pos", F.size("x.own").alias("n"), "x.own")


def _windows(rows: DataFrame) -> DataFrame:
    """The same for every two lines, not both blank, that follow one another, are not both boundaries, which makes them a chunk, and are
    not within one of the chunks ``cut``."""
    inside = lambda i: F.exists("cut", lambda c: (c["pos"] <= i) & (i + 1 < c["pos"] + c["n"]))
    chunk = lambda i: is_boundary(F.get("h", i)) & is_boundary(F.get("h", i + 1))
    free = F.filter(F.sequence(F.lit(0), F.size("h") - 2), lambda i: ~chunk(i) & ~inside(i) & (F.get("full", i) | F.get("full", i + 1)))
    some = rows.where(F.size("h") > 1).select("_sl_id", "_sl_key", "h", F.explode(free).alias("pos"))
    return some.select("_sl_id", "_sl_key", "pos", F.lit(2).alias("n"), F.slice("h", F.col("pos") + 1, 2).alias("own"))


def _repeated(runs: DataFrame, name: str) -> DataFrame:
    """``runs`` whose lines stand in several places, without them, and whether each is a later place that does not overlap
    the first. Places are ordered by doc_id and position; a null doc_id comes last."""
    doc = F.coalesce("_sl_id", F.lit((1 << 63) - 1)).cast("decimal(38,0)") * F.lit(1 << 31).cast("decimal(11,0)")
    place = ((doc + F.pmod("_sl_key", F.lit(1 << 31))) * F.lit(1 << 31).cast("decimal(11,0)") + F.col("pos")).cast("decimal(38,0)")
    placed = runs.withColumn("place", place)
    found = placed.groupBy("own").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first <> last")
    # Written first, so that the join deals out both its sides itself and Spark may split a run of very many places.
    found = materialise(found.select("own", "first"), name)
    return placed.join(found, "own").select("_sl_id", "_sl_key", "pos", "n", (F.col("place") - F.col("first") > 1).alias("later"))


def repeated_runs(rows: DataFrame) -> DataFrame:
    """(_sl_id, _sl_key, runs): for each row of ``hashed`` that has any its repeated runs (pos, n, later): first chunks that
    are equal as wholes, then every two lines that are no chunk and in no later place of one, which is what runs share inside
    chunks that do not repeat. A later place of a chunk holds only lines that its first place has, so nothing is lost by leaving it out,
    and copies of whole texts give few rows."""
    rows = materialise(rows, "line-hashes")
    chunks = materialise(_repeated(_chunks(rows), "chunks"), "chunk-places")
    cut = chunks.where("later").groupBy("_sl_id", "_sl_key").agg(F.collect_set(F.struct("pos", "n")).alias("cut"))
    rest = rows.join(cut.withColumnRenamed("_sl_id", "_sl_i"), (F.col("_sl_id").eqNullSafe(F.col("_sl_i"))) & (rows["_sl_key"] == cut["_sl_key"]), "left")
    rest = rest.select(rows["_sl_id"], rows["_sl_key"], "h", "full", F.coalesce("cut", F.array().cast("array<struct<pos:int,n:int>>")).alias("cut"))
    both = chunks.unionByName(_repeated(_windows(rest), "windows"))
    return both.groupBy("_sl_id", "_sl_key").agg(F.collect_set(F.struct("pos", "n", "later")).alias("runs"))


def _with_runs(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` with the column _sl_runs, written."""
    found = repeated_runs(rows)
    key = F.xxhash64(docs["doc_id"], docs["text"])
    joined = docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found["_sl_id"]) & (key == found["_sl_key"]), "left")
    names = [f"_sl_{i}" for i in range(len(docs.columns))]
    runs = F.coalesce(found["runs"], F.array().cast("array<struct<pos:int,n:int,later:boolean>>"))
    return materialise(joined.select(*[docs[c].alias(n) for c, n in zip(docs.columns, names, strict=True)], runs.alias("_sl_runs")), "runs")


def _lines_of(runs: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(runs, lambda r: F.sequence(r["pos"], r["pos"] + r["n"] - 1))))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated runs of two lines or more cut from ``text``, and n_lines and n_removed beside its columns.

    A line goes if it and a neighbour, not both blank, stand in that order in an earlier place too, by doc_id and position,
    so the earliest place of each line that goes stays. Runs are found by line hashes; the bytes of all lines of repeated
    runs are compared, and lines that share their hashes are numbered and the search repeated with the numbers. A null text
    stays null and has one empty line, as has an empty one; lines that repeat singly and blank runs always stay; rows equal
    in doc_id and text count as one place; a null doc_id comes after all others. Every other column passes through, and an
    empty table gives no rows.
    """
    text = f"_sl_{docs.columns.index('text')}"
    found = _with_runs(docs, hashed(docs))
    lines = found.where(F.size("_sl_runs") > 0).select(F.explode(_let(_split(text), lambda x: F.transform(_lines_of(F.col("_sl_runs")), lambda i: F.get(x, i)))).alias("line"))
    a, b = line_hash(F.col("line"))
    known = lines.select(a.alias("a"), b.alias("b"), "line").distinct()
    collided = materialise(known.join(known.groupBy("a", "b").count().where("count > 1").select("a", "b"), ["a", "b"]), "collided")
    if not collided.isEmpty():
        found = _with_runs(docs, _told_apart(docs, collided))
    # Of a chunk, as of any run, two blank lines that follow one another go only with a neighbour that is not blank.
    x = F.col("_sl_lines")
    windows = lambda r: F.filter(F.sequence(r["pos"], r["pos"] + r["n"] - 2), lambda i: F.get(x, i).rlike(r"\S") | F.get(x, i + 1).rlike(r"\S"))
    later = F.array_distinct(F.flatten(F.transform(F.filter("_sl_runs", lambda r: r["later"]), windows)))
    cut = found.withColumn("_sl_lines", _split(text)).withColumn("_sl_later", later).withColumn("_sl_gone", F.array_union("_sl_later", F.transform("_sl_later", lambda i: i + 1)))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_sl_lines") - 1), F.col("_sl_gone"))
    new = F.when(F.size("_sl_gone") == 0, F.col(text)).otherwise(F.array_join(F.transform(kept, lambda i: F.get("_sl_lines", i)), "\n"))
    counts = [F.size("_sl_lines").cast("long").alias("n_lines"), F.size("_sl_gone").cast("long").alias("n_removed")]
    return cut.select(*[(new if f"_sl_{i}" == text else F.col(f"_sl_{i}")).alias(c) for i, c in enumerate(docs.columns)], *counts)
