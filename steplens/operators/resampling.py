"""Bootstrap draws of rows as multinomial counts of equal rows, split from steps to blocks of scores and from blocks to scores; and
counts of rows picked one by one in whole numbers that any engine repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct scores of a step that one task draws for at once.
BLOCK_SCORES = 2048


def row_counts(histogram: DataFrame, draws: int, step: str = "step", seed: int = 2, block_scores: int = BLOCK_SCORES) -> DataFrame:
    """(draw, step, score, n, pos): in each draw as many rows of each step as the histogram (step, score, n, pos) has, drawn with
    replacement. Rows that are alike are drawn as a number, so a draw costs distinct scores and not rows.

    The scores of a step are dealt into blocks by a hash. A seeded multinomial of a draw and a step splits the step's rows among its
    blocks, and one of the draw, the step and the block splits these among the scores and labels of the block. Every task of a
    step makes the first split anew from the block sizes, so no counts travel. Draws agree whenever the histogram does."""
    sizes = histogram.groupBy(step).agg(F.ceil(F.count("*") / block_scores).cast("int").alias("_m"))
    own = histogram.join(sizes, step).select(step, "score", F.col("n").cast("long").alias("n"), F.col("pos").cast("long").alias("pos"), F.pmod(F.xxhash64("score"), F.col("_m")).cast("int").alias("_block"))
    blocks = own.groupBy(step, "_block").agg(F.sum("n").alias("_size"))
    masses = blocks.groupBy(step).agg(F.sort_array(F.collect_list(F.struct("_block", "_size"))).alias("_masses"))
    known = blocks.join(masses, step).select(F.col(step).alias("_of"), F.col("_block").alias("_at"), F.col("_masses._block").alias("_names"), F.col("_masses._size").alias("_sizes"))
    kind = histogram.schema[step].dataType.simpleString()

    def draw(part: pa.Table, whole: pa.Table) -> pa.Table:
        rng = lambda *k: np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, *[int(x) & 0xFFFFFFFF for x in k]])))
        order = np.argsort(part["score"].to_numpy(), kind="stable")
        score, n, pos = (part[c].to_numpy()[order] for c in ("score", "n", "pos"))
        of, block = part[step][0].as_py(), part["_block"][0].as_py()
        sizes, place = np.array(whole["_sizes"][0].as_py(), float), whole["_names"][0].as_py().index(block)
        share = np.concatenate([pos, n - pos]) / n.sum()
        out = []
        for d in range(draws):
            count = int(rng(d, of).multinomial(int(sizes.sum()), sizes / sizes.sum())[place])
            hits = rng(d, of, block, 1).multinomial(count, share).reshape(2, -1)
            some = np.flatnonzero(hits.any(axis=0))
            out.append((np.full(len(some), d), score[some], hits[:, some].sum(axis=0), hits[0, some]))
        draw, score, n, pos = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"draw": draw, step: pa.array([of] * len(draw), part[step].type), "score": score, "n": n, "pos": pos})

    return own.groupBy(step, "_block").cogroup(known.groupBy("_of", "_at")).applyInArrow(draw, f"draw long, {step} {kind}, score double, n long, pos long")


def row_draws(histogram: DataFrame, draws: int, step: str = "step", seed: int = 2) -> DataFrame:
    """(draw, score, n, pos): the histogram of each draw over all steps."""
    return row_counts(histogram, draws, step, seed).groupBy("draw", "score").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))


#: The prime and the factor of the mixing that any engine repeats in whole numbers of 64 bits.
PRIME, FACTOR = 2147483647, 48271


def mixed(x: np.ndarray, rounds: int = 2) -> np.ndarray:
    """The numbers that ``joins.mixed`` scatters whole numbers above 0 to."""
    x = x % PRIME
    for _ in range(rounds):
        x = (x * x % PRIME * FACTOR + x + 11) % PRIME
    return x


#: Draws and slots that one row of ``picked`` stands for, and slots picked at once.
UNIT_DRAWS, UNIT_SLOTS, SLOTS = 8, 1 << 22, 1 << 18


def picked(runs: DataFrame, draws: int, step: str = "step", seed: int = 2) -> DataFrame:
    """(draw, score, n, pos), to be summed: counts of picks of ``runs`` (step, score, y, upto, total), runs of equal rows that end before
    place ``upto`` of the ``total`` of their step. A draw picks one place for each slot of a step, as ``joins.drawn`` does.

    A step's runs are one row of arrays, and go to each unit of some draws and slots; picks are counted by run as they are made, so
    what travels is runs and never picks."""
    own = runs.groupBy(step).agg(F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("upto", "score", "y"))).alias("runs"))
    own = own.select(F.col(step).alias("step"), "total", F.col("runs.upto").alias("upto"), F.col("runs.score").alias("score"), F.col("runs.y").alias("y"))
    units = own.select("*", F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.lit(UNIT_DRAWS))).alias("first")).select("*", F.explode(F.expr(f"sequence(0L, total - 1, {UNIT_SLOTS}L)")).alias("slot"))
    # By number, as units are few bytes and much work.
    units = units.repartition(max(64, 4 * runs.sparkSession.sparkContext.defaultParallelism), "step", "first", "slot")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                of, total, first, begin = (batch.column(c)[i].as_py() for c in ("step", "total", "first", "slot"))
                upto, score, y = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("upto", "score", "y"))
                for d in range(first, min(first + UNIT_DRAWS, draws)):
                    hits = np.zeros(len(upto), np.int64)
                    for at in range(begin, min(begin + UNIT_SLOTS, total), SLOTS):
                        slot = np.arange(at, min(at + SLOTS, begin + UNIT_SLOTS, total), dtype=np.int64)
                        place = mixed(d * 7919 + (slot * 64 + of) * 104729 + seed * 15485863) % total
                        hits += np.bincount(np.searchsorted(upto, place, side="right"), minlength=len(upto))
                    some = np.flatnonzero(hits)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), d)), pa.array(score[some]), pa.array(hits[some]), pa.array((hits * y)[some])], ["draw", "score", "n", "pos"])

    return units.select(F.col("step").cast("long").alias("step"), "total", "first", "slot", "upto", "score", "y").mapInArrow(count, "draw long, score double, n long, pos long")
