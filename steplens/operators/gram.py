"""Sums of products of every two columns, gathered batch by batch, and the correlations that they give."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that one product takes at once.
BLOCK = 8192
_SUMS = ("n", "x", "y", "xx", "yy", "xy")


def pair_sums(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, n, x, y, xx, yy, xy) for every two columns i < j: over the rows where both are finite, their number and the sums of both,
    of their squares and of their product, less a first guess of each column's mean. A task adds up the matrix products of its batches
    and sends one row a pair; what is held is quadratic in the columns alone."""
    p = len(columns)
    wide = df.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)])
    finite = lambda c: F.when(F.abs(c) < float("inf"), F.col(c))
    first = wide.agg(*[F.avg(finite(c)).alias(c) for c in wide.columns]).first()
    shift = [first[k] or 0.0 for k in range(p)]
    upper = np.triu_indices(p, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((4, p, p)), False
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = np.stack([pc.fill_null(part.column(k), float("nan")).to_numpy() - shift[k] for k in range(p)], axis=1)
                ok = np.isfinite(x)
                x, m = np.where(ok, x, 0.0), ok.astype(float)
                total += np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
                seen = True
        if seen:
            n, one, two, xy = total
            values = [n[upper], one[upper], one.T[upper], two[upper], two.T[upper], xy[upper]]
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)) for k in upper] + [pa.array(v) for v in values], ["i", "j", *_SUMS])

    rows = wide.mapInArrow(run, "i int, j int, " + ", ".join(f"{s} double" for s in _SUMS))
    return rows.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in _SUMS])


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, i, j, r) for every two columns, a before b in the list, over the rows where both are finite; null where one is constant
    or no row is left."""
    s = {c: F.col(c) for c in _SUMS}
    spread = lambda total, squares: s["n"] * squares - total * total
    both = spread(s["x"], s["xx"]) * spread(s["y"], s["yy"])
    # squares of centred values cannot cancel to less than rounding leaves of them
    steady = (spread(s["x"], s["xx"]) > 1e-12 * s["n"] * s["xx"]) & (spread(s["y"], s["yy"]) > 1e-12 * s["n"] * s["yy"])
    r = F.when(steady, (s["n"] * s["xy"] - s["x"] * s["y"]) / F.sqrt(both))
    names = F.array(*[F.lit(c) for c in columns])
    return pair_sums(df, columns).select(F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), "i", "j", r.alias("r"))
