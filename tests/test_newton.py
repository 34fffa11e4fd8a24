"""Logistic regressions of many windows in shared passes against one plain fit each."""

import random

import numpy as np
import pytest

from steplens.operators import newton


def plain(rows, window, half_life=5.0, ridge=newton.RIDGE):
    """Iteratively reweighted least squares over the rows of one window, features standardised over all rows."""
    x = np.array([[a or 0.0, b] for _, _, a, b in rows])
    mean, scale = x.mean(axis=0), x.std(axis=0)
    first, last, weighted = window
    own = [(s, y, [(a or 0.0, b)]) for s, y, a, b in rows if y is not None and first <= s <= last]
    y = np.array([r[1] for r in own], float)
    z = np.column_stack([(np.array([r[2][0] for r in own]) - mean) / scale, np.ones(len(own))])
    a = np.array([0.5 ** ((last - r[0]) / half_life) if weighted else 1.0 for r in own])
    a = np.where(y == 1, a * 0.5 / a[y == 1].sum(), a * 0.5 / a[y == 0].sum())
    beta, hold = np.zeros(3), np.diag([ridge, ridge, 0])
    for _ in range(60):
        q = 1 / (1 + np.exp(-z @ beta))
        beta = beta + np.linalg.solve((z * (a * q * (1 - q))[:, None]).T @ z + hold, z.T @ (a * (y - q)) - hold @ beta)
    w = beta[:2] / scale
    return w, beta[2] - w @ mean


def test_windows_against_plain_fits(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(900):
        s, a = rng.randrange(1, 13), rng.gauss(0, 3)
        b = 0.8 * a + rng.gauss(0, 1)  # the two go together
        y = int(rng.random() < 1 / (1 + np.exp(-(a - b + 0.1 * s))))
        rows.append((s, y, 1e4 + 100 * a, b))
    everything = [(s, y, a, b) for s, y, a, b in rows]
    df = spark.createDataFrame([*rows, (3, None, 5.0, 5.0)], "step int, y int, a double, b double").repartition(4)
    windows = [(1, 12, False), (1, 6, True), (4, 9, False), (1, 12, False), (20, 30, False)]
    got = {(r["first"], r["last"], r["weighted"]): (r["w"], r["c"]) for r in newton.fit_windows(df, windows, ["a", "b"]).collect()}
    assert set(got) == set(windows[:3])  # repeated windows once, windows without rows not at all
    for window, (w, c) in got.items():
        want, constant = plain(everything, window)
        assert w == pytest.approx(want, rel=1e-5) and c == pytest.approx(constant, rel=1e-5)
    assert got[1, 12, False][0][0] > 0 > got[1, 12, False][0][1]  # a diagonal model would give both the same sign


def test_classes_that_a_line_parts_and_empty_tables(spark):
    df = spark.createDataFrame([(1, int(i > 5), float(i), 0.0) for i in range(12)], "step int, y int, a double, b double")
    (r,) = newton.fit_windows(df, [(1, 1, False)], ["a", "b"]).collect()
    assert all(np.isfinite([*r["w"], r["c"]])) and all((r["w"][0] * i + r["c"] > 0) == (i > 5) for i in range(12))
    assert newton.fit_windows(df.limit(0), [(1, 1, False)], ["a", "b"]).collect() == []
    assert newton.fit_windows(df.where("y = 1"), [(1, 1, False)], ["a", "b"]).collect() == []


def test_repeated_rows_are_passed_over_once(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(s, int(rng.random() < 0.5), rng.gauss(0, 1) if rng.random() < 0.9 else None, rng.gauss(0, 1)) for s in (1, 2, 3, 4) for _ in range(25)]
    written, write = [], newton.materialise
    monkeypatch.setattr(newton, "materialise", lambda df, name: written.append(write(df, name)) or written[-1])
    df = spark.createDataFrame(rows * 40 + rows[:30], "step int, y int, a double, b double").repartition(3)
    windows = [(1, 4, True), (2, 3, False), (1, 1, False)]
    got = {(r["first"], r["last"], r["weighted"]): (r["w"], r["c"]) for r in newton.fit_windows(df, windows, ["a", "b"]).collect()}
    assert [t.count() for t in written] == [len(rows)]
    for window in windows:
        want, constant = plain(rows * 40 + rows[:30], window)
        assert got[window][0] == pytest.approx(want, rel=1e-5) and got[window][1] == pytest.approx(constant, rel=1e-5)
