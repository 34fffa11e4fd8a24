"""Joins: labels, scores, strict as-of, bridges, grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steplens.operators.resampling import FACTOR as _FACTOR
from steplens.operators.resampling import PRIME as _PRIME
from steplens.operators.resampling import picked
from steplens.sources.scratch import materialise


def join_scores(base: DataFrame, scores: DataFrame, key: str = "tx_id", truth: str = "y", saved_truth: str = "y_true") -> DataFrame:
    """``base`` with saved scores and whether their truth agrees with the table's."""
    return base.join(scores, key, "left").withColumn("agrees", F.col(truth).eqNullSafe(F.col(saved_truth)))


#: Steps of one key that one window holds; what lies before them is carried.
SEGMENT = 64


def asof_prior_snapshot(events: DataFrame, snapshots: DataFrame, key: str, step: str, value: str, order: list[str] | None = None, segment: int = SEGMENT, parts: int | None = None) -> DataFrame:
    """``events`` with the value and step of the latest snapshot of their key strictly before their own step.

    Events of one key and step have one answer, so keys and steps meet first: both sides shrink to their distinct ones before any
    shuffle, and keys are cut into segments of steps. A segment begins with the last snapshot of those before it, carried in a table of
    segments; inside it a window runs over its steps. So an address that holds half of all rows is no larger than its steps, and
    its rows are spread as they get their answers. At equal steps events come before snapshots. Snapshots of one key and step are
    taken as equal, the largest value otherwise. No history gives nulls. ``order`` is of no account. ``parts`` tasks share each step of the
    work, where that is given, so that none grows with the tables; nothing is made distinct before it travels then."""
    deal = (lambda df, *by: df.repartition(parts, *by)) if parts else (lambda df, *by: df)
    cut = F.floor(F.col("_step") / segment).alias("_seg")
    # A key in a struct is never null, so nulls meet as values; its hash before it is what sorts compare.
    same = [F.xxhash64(F.col(key)).alias("_hash"), F.struct(F.col(key).alias("of")).alias("_key")]
    of = ["_hash", "_key"]
    own = deal(snapshots.select(*same, F.col(step).cast("long").alias("_step"), F.col(value).alias("_v")), *of, "_step")
    s = own.groupBy(*of, "_step").agg(F.max("_v").alias("_v")).select(*of, "_step", cut, F.struct(F.col("_step").alias("at"), "_v").alias("snap"), F.lit(1).alias("side"))
    asked = deal(events.select(*same, F.col(step).cast("long").alias("_step")), *of, "_step").distinct()
    both = s.unionByName(asked.select(*of, "_step", cut, F.lit(None).cast(s.schema["snap"].dataType).alias("snap"), F.lit(0).alias("side")))
    both = deal(materialise(both, "asof") if parts else both, *of, "_seg")
    ends = both.groupBy(*of, "_seg").agg(F.max(F.when(F.col("snap").isNotNull(), F.col("snap"))).alias("last"))
    before = F.last("last", True).over(Window.partitionBy(*of).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1))
    carried = deal(deal(ends, *of).select(*of, "_seg", before.alias("carried")), *of, "_seg")
    within = Window.partitionBy(*of, "_seg").orderBy("_step", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("snap", F.last("snap", True).over(within)).where("side = 0")
    # A null step is no step of a segment; it has no answer.
    found = seen.join(carried, [*of, "_seg"]).select(*of, "_step", F.coalesce("snap", "carried").alias("_snap"))
    asking = events.select("*", *same, F.col(step).cast("long").alias("_step"))
    joined = deal(asking, *of, "_step").join(deal(found, *of, "_step"), [*of, "_step"], "left")
    return joined.select(*events.columns, F.col("_snap._v").alias("prior_value"), F.col("_snap.at").cast("int").alias("prior_step"))


def bridge(membership: DataFrame, steps: DataFrame, tx: str = "tx_id", address: str = "address", step: str = "step", cut: int | None = None) -> DataFrame:
    """Transactions that share an address with a strictly earlier one, or with one up to step ``cut``: the least step of
    each address, then of each transaction's addresses. Pairs of transactions are never made."""
    own = membership.join(steps.select(tx, step), tx)
    least = own.groupBy(address).agg(F.min(step).alias("address_min"))
    found = own.join(least, address).groupBy(tx, step).agg(F.min("address_min").alias("min_step"))
    rule = F.col("min_step") < F.col(step) if cut is None else F.col("min_step") <= cut
    return found.select(tx, step, "min_step", rule.alias("bridged"))


def score_histogram(df: DataFrame, score: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Rows and positives of each distinct score: what every curve and threshold search starts from."""
    return df.where(F.col(y).isNotNull() & F.col(score).isNotNull()).groupBy(*(by or []), F.col(score).alias("score")).agg(F.count("*").alias("n"), F.sum(y).cast("long").alias("pos"))


def grid_bin(grid: list[float], score: str = "score") -> Column:
    """How many thresholds of an ascending grid a score reaches."""
    taus = F.array(*[F.lit(float(t)) for t in grid])
    step = (grid[-1] - grid[0]) / max(1, len(grid) - 1)
    if step <= 0 or any(abs(grid[0] + i * step - t) >= 1e-9 for i, t in enumerate(grid)):
        return F.size(F.filter(taus, lambda t: t <= F.col(score)))
    # even: a guess, put right by the neighbours
    guess = F.least(F.greatest(F.floor((F.col(score) - grid[0]) / step).cast("int"), F.lit(0)), F.lit(len(grid) - 1))
    return F.when(F.col(score) < F.get(taus, guess), guess).when((guess < len(grid) - 1) & (F.col(score) >= F.get(taus, guess + 1)), guess + 2).otherwise(guess + 1)


def cross_threshold(histogram: DataFrame, grid: list[float], by: list[str] | None = None) -> DataFrame:
    """(tau, tp, fp, fn) of every candidate of an ascending ``grid``. Each distinct score falls into one bin between candidates; only
    the counts of bins meet all candidates."""
    by = by or []
    bins = histogram.groupBy(*by, grid_bin(grid).alias("_bin")).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    tried = bins.select(*by, "_bin", "n", "pos", F.posexplode(F.array(*[F.lit(float(t)) for t in grid])).alias("_at", "tau"))
    hit = F.col("_bin") > F.col("_at")
    return tried.groupBy(*by, "tau").agg(F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("n") - F.col("pos")).otherwise(0)).alias("fp"), F.sum(F.when(~hit, F.col("pos")).otherwise(0)).alias("fn"))


def mixed(x: str, rounds: int = 2) -> str:
    """SQL text, for Spark and others alike, of a number from 0 to 2 ** 31 - 2 that ``x``, a whole number, scatters to."""
    x = f"(({x}) % {_PRIME})"
    for _ in range(rounds):
        x = f"(({x} * {x} % {_PRIME} * {_FACTOR} + {x} + 11) % {_PRIME})"
    return x


def drawn(draw: str, slot: str, seed: int = 1) -> str:
    """The same for a draw and a slot of it."""
    return mixed(f"{draw} * 7919 + {slot} * 104729 + {seed} * 15485863")


#: Rounds of a keyed permutation between two looks at whether it has come back into its range, and looks at most.
_ROUNDS, _LOOKS = 6, 16


def permuted(place: str, size: str, seed: str, duck: bool = False) -> str:
    """SQL text, for Spark or for DuckDB, of the place from 0 to ``size`` - 1 that a keyed permutation of these places gives ``place``.

    A Feistel network over the cells of a grid of ``_grid_a`` rows and ``_grid_b`` columns, the least one of about equal sides that has
    ``size`` cells, walked on from cells beyond ``size``; ``grid`` gives the sides as columns. A walk that has ended is kept as a
    number below 0."""
    low, high = "x % _grid_b", "x // _grid_b" if duck else "x div _grid_b"
    push = lambda v: mixed(f"({v}) * 31 + r % {_ROUNDS} * 7919 + {seed} * 104729", 1)
    even, odd = f"(({high}) + {push(low)}) % _grid_a * _grid_b + {low}", f"({high}) * _grid_b + ({low} + {push(high)}) % _grid_b"
    step = f"CASE WHEN x < 0 THEN x WHEN r % {_ROUNDS} = 0 AND r > 0 AND x < {size} THEN -x - 1 WHEN r % 2 = 0 THEN {even} ELSE {odd} END"
    last = _ROUNDS * _LOOKS
    if duck:
        return f"(-1 - list_reduce(list_prepend(cast({place} as bigint), range(0, {last + 1})), lambda x, r: {step}))"
    return f"aggregate(sequence(0L, {last}L), CAST({place} AS BIGINT), (x, r) -> {step}, x -> -1 - x)"


def grid(size: str) -> list[tuple[str, str]]:
    """(name, SQL text) of the sides of the grid that ``permuted`` needs, for a column of sizes above 0."""
    a = f"CAST(ceil(sqrt({size})) AS BIGINT)"
    return [("_grid_a", a), ("_grid_b", f"CAST(ceil({size} / CAST({a} AS DOUBLE)) AS BIGINT)")]


def draw_weights(spark, draws: int, slots: list[int], seed: int = 1) -> DataFrame:
    """(draw, step, weight): how often each step is drawn with replacement, as many as there are. One row for each draw and
    step drawn."""
    n = len(slots)
    base = spark.range(draws).withColumnRenamed("id", "draw").withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    pick = F.expr(f"CAST({drawn('draw', 'slot', seed)} % {n} AS INT)")
    return base.select("draw", F.get(F.array(*[F.lit(s) for s in slots]), pick).alias("step")).groupBy("draw", "step").agg(F.count("*").alias("weight"))


#: Runs of equal rows of a step that one row may hold as arrays.
MOST_RUNS = 1 << 17


def row_draws(histogram: DataFrame, draws: int, step: str = "step", seed: int = 2, most_runs: int = MOST_RUNS) -> DataFrame:
    """(draw, score, n, pos): the histogram (step, score, n, pos) of as many rows of each step as there are, drawn with
    replacement. A draw picks places in the order of a step's scores, positives first, so rows themselves are never ordered or
    repeated: picks fall into the runs of equal rows.

    Picks of a step of up to ``most_runs`` runs are counted as they are made. Those of a step of more meet its places in a join that sorts
    both sides; neither is sent whole to anyone, however short Spark takes it for."""
    runs = histogram.select(step, "score", F.explode(F.array(F.struct(F.lit(1).alias("y"), F.col("pos").alias("m")), F.struct(F.lit(0).alias("y"), (F.col("n") - F.col("pos")).alias("m")))).alias("r")).select(step, "score", "r.y", "r.m").where("m > 0")
    w = Window.partitionBy(step).orderBy(F.desc("score"), F.desc("y"))
    whole = Window.partitionBy(step)
    runs = materialise(runs.select(step, "score", "y", "m", F.sum("m").over(w).alias("upto"), F.sum("m").over(whole).alias("total"), F.count("*").over(whole).alias("_runs")), "runs")
    found = picked(runs.where(F.col("_runs") <= most_runs), draws, step, seed)
    many = runs.where(F.col("_runs") > most_runs)
    if not many.isEmpty():
        found = found.unionByName(_picks_of_places(many, draws, step, seed))
    return found.groupBy("draw", "score").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))


def _picks_of_places(runs: DataFrame, draws: int, step: str, seed: int) -> DataFrame:
    sizes = runs.groupBy(step).agg(F.max("total").alias("total"))
    picks = sizes.select(step, "total", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))).alias("draw")).select(step, "draw", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1)).alias("slot"))
    picks = picks.select(step, "draw", F.expr(f"{drawn('draw', f'(slot * 64 + {step})', seed)} % total").alias("at")).groupBy(step, "draw", "at").agg(F.count("*").alias("k"))
    # Each place of a step once, with the score and label that stand there.
    places = runs.select(step, "score", "y", F.explode(F.sequence(F.col("upto") - F.col("m"), F.col("upto") - 1)).alias("at"))
    hits = picks.join(places.hint("merge"), [step, "at"])
    return hits.select("draw", "score", F.col("k").alias("n"), F.expr("k * y").alias("pos"))
