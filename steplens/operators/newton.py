"""Logistic regressions of many windows of steps at once: each Newton round is one pass over the rows that adds up the gradients and
Hessians of all windows, and small solves beside it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steplens.sources.scratch import materialise

#: Rounds at most, the largest step of a standardised weight that still asks for another, and the ridge on these weights.
ROUNDS, SMALL_STEP, RIDGE = 25, 1e-8, 1e-4


def alike(df: DataFrame, columns: list[str], y: str = "y") -> DataFrame:
    """(columns, _n): how often each labelled row stands in ``df``, written. Rows that are alike weigh and score alike, so what comes after
    costs distinct rows."""
    return materialise(df.where(F.col(y).isNotNull()).groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")), "alike")


def _sums(rows: DataFrame, beta: np.ndarray, windows: list[tuple], balance: np.ndarray, mean: np.ndarray, scale: np.ndarray, half_life: float) -> np.ndarray:
    """(windows, (p + 1) * (p + 2)): Hessian and gradient of each window at ``beta``, over one pass."""
    n, p = beta.shape[0], beta.shape[1] - 1
    first, last, weighted = (np.array(v) for v in zip(*windows, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, (p + 1) * (p + 2)))
        for batch in batches:
            step, y, times = (batch.column(k).to_numpy() for k in range(3))
            x = np.stack([pc.fill_null(batch.column(k + 3), 0.0).to_numpy() for k in range(p)] + [np.ones(batch.num_rows)], axis=1)
            x[:, :p] = (x[:, :p] - mean) / scale
            order = np.lexsort((y, step))
            step, y, times, x = step[order], y[order], times[order], x[order]
            starts = np.flatnonzero(np.r_[True, (step[1:] != step[:-1]) | (y[1:] != y[:-1])]) if len(step) else []
            # Rows of one step and label meet all windows of that step in matrix products; what windows weigh them by is one number each.
            for lo, hi in zip(starts, [*starts[1:], len(step)], strict=True):
                m = np.flatnonzero((first <= step[lo]) & (step[lo] <= last))
                own = x[lo:hi]
                counted = own * times[lo:hi, None]
                q = 1 / (1 + np.exp(-np.clip(own @ beta[m].T, -500, 500)))
                products = (counted[:, :, None] * own[:, None, :]).reshape(hi - lo, -1)
                a = balance[m, 1 if y[lo] == 1 else 0] * np.where(weighted[m], 0.5 ** ((last[m] - step[lo]) / half_life), 1.0)
                total[m, : (p + 1) ** 2] += a[:, None] * ((q * (1 - q)).T @ products)
                total[m, (p + 1) ** 2 :] += a[:, None] * ((y[lo] - q).T @ counted)
        window, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(window.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(total[window, place])], ["window", "place", "value"])

    found = rows.mapInArrow(run, "window int, place int, value double").groupBy("window", "place").agg(F.sum("value").alias("value"))
    out = np.zeros((n, (p + 1) * (p + 2)))
    for r in found.collect():  # windows x (features + 1) x (features + 2)
        out[r["window"], r["place"]] = r["value"]
    return out


def fit_windows(df: DataFrame, windows: list[tuple[int, int, bool]], features: list[str], half_life: float = 5.0, step: str = "step", y: str = "y", ridge: float = RIDGE) -> DataFrame:
    """(first, last, weighted, w, c): weights and constant of the logistic regression of the labelled rows of each distinct window, steps
    ``first`` to ``last``. Both classes weigh the same; steps weigh 0.5 ** (age / half-life) where a window is weighted. Windows without
    one of the classes are left out. Missing features count as 0; the ridge holds standardised weights, not the constant."""
    spark = df.sparkSession
    p = len(features)
    kind = "first int, last int, weighted boolean, w array<double>, c double"
    given = df.where(F.col(y).isNotNull()).select(F.col(step).cast("int").alias("_s"), F.col(y).cast("int").alias("_y"), *[F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(features)])
    stats = given.agg(*[f(F.coalesce(f"_x{k}", F.lit(0.0))) for k in range(p) for f in (F.avg, F.stddev_pop)]).first()
    rows = alike(given, given.columns, "_y").select("_s", "_y", "_n", *[f"_x{k}" for k in range(p)])
    mean = np.array([stats[2 * k] or 0.0 for k in range(p)])
    scale = np.array([stats[2 * k + 1] or 1.0 for k in range(p)])
    counts = {(r["_s"], r["_y"]): r["count"] for r in rows.groupBy("_s", "_y").agg(F.sum("_n").alias("count")).collect()}  # two rows a step

    def size(window: tuple, label: int) -> float:
        first, last, weighted = window
        return sum(n * (0.5 ** ((last - s) / half_life) if weighted else 1.0) for (s, v), n in counts.items() if v == label and first <= s <= last)

    known = [w for w in dict.fromkeys(windows) if size(w, 0) and size(w, 1)]
    if not known:
        return spark.createDataFrame([], kind)
    balance = np.array([[0.5 / size(w, 0), 0.5 / size(w, 1)] for w in known])
    beta, hold = np.zeros((len(known), p + 1)), np.diag([ridge] * p + [1e-12])
    going = np.arange(len(known))
    for _ in range(ROUNDS):
        total = _sums(rows, beta[going], [known[i] for i in going], balance[going], mean, scale, half_life)
        moved = np.zeros(len(going))
        for k, i in enumerate(going):
            h, g = total[k, : (p + 1) ** 2].reshape(p + 1, p + 1), total[k, (p + 1) ** 2 :]
            step_ = np.linalg.solve(h + hold, g - hold @ beta[i])
            step_ /= max(1.0, np.abs(step_).max() / 5)  # no further than five deviations at once
            beta[i] += step_
            moved[k] = np.abs(step_).max()
        going = going[moved > SMALL_STEP]
        if not len(going):
            break
    w = beta[:, :p] / scale
    c = beta[:, p] - w @ mean
    return spark.createDataFrame([(*known[i], w[i].tolist(), float(c[i])) for i in range(len(known))], kind).coalesce(1)
