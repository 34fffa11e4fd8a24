"""Draws are fair, and thresholds of the grid agree with trying every one."""

import random

import numpy as np
import pytest

from steplens.operators import joins, ranking


def test_draws_of_steps_are_fair(spark):
    rows = joins.draw_weights(spark, 2000, list(range(15))).collect()
    weight = np.zeros((2000, 15))
    for r in rows:
        weight[r["draw"], r["step"]] = r["weight"]
    assert (weight.sum(axis=1) == 15).all()
    assert np.abs(weight.mean(axis=0) - 1).max() < 0.1  # four deviations of the mean
    assert abs(weight.var() - 14 / 15) < 0.06
    distinct = (weight > 0).sum(axis=1)
    assert abs(distinct.mean() - 15 * (1 - (14 / 15) ** 15)) < 0.15 and distinct.min() >= 5 and distinct.max() <= 14
    link = np.corrcoef(weight.T)
    assert np.abs(link[~np.eye(15, dtype=bool)] + 1 / 14).max() < 0.12
    other = joins.draw_weights(spark, 50, list(range(15)), seed=9).collect()
    assert {(r["draw"], r["step"], r["weight"]) for r in other} != {(r["draw"], r["step"], r["weight"]) for r in rows if r["draw"] < 50}


def test_draws_of_rows_are_as_many_as_the_rows(spark):
    h = spark.createDataFrame([(1, 0.9, 4, 3), (1, 0.1, 36, 2), (2, 0.5, 10, 10)], "step int, score double, n long, pos long")
    rows = joins.row_draws(h, 1500).collect()
    by = {(r["draw"], r["score"]): (r["n"], r["pos"]) for r in rows}
    n = np.array([[by.get((d, s), (0, 0))[0] for s in (0.9, 0.1, 0.5)] for d in range(1500)])
    pos = np.array([[by.get((d, s), (0, 0))[1] for s in (0.9, 0.1, 0.5)] for d in range(1500)])
    assert (n[:, 0] + n[:, 1] == 40).all() and (n[:, 2] == 10).all() and (pos[:, 2] == 10).all() and (pos <= n).all()
    assert n[:, 0].mean() == pytest.approx(4, abs=0.25) and n[:, 0].var() == pytest.approx(3.6, rel=0.2)
    assert pos[:, 1].mean() == pytest.approx(2, abs=0.2) and pos[:, 1].var() == pytest.approx(2 * 38 / 40, rel=0.2)


def test_picks_are_counted_where_they_are_made(spark, monkeypatch):
    """Picks of rows, which are rows times draws, were one table that met all places in a join."""
    from steplens.operators import resampling

    runs = [(s, i / 50, 40 + i, i % 7) for s in (35, 36) for i in range(50)] + [(49, 0.5, 1, 1)]
    h = spark.createDataFrame(runs, "step int, score double, n long, pos long")
    want = {}
    for s in (35, 36, 49):
        rows = [(x, y) for _, x, n, pos in sorted((r for r in runs if r[0] == s), reverse=True) for y in [1] * pos + [0] * (n - pos)]
        for d in range(20):
            for slot in range(len(rows)):
                x, y = rows[int(resampling.mixed(np.int64(d * 7919 + (slot * 64 + s) * 104729 + 2 * 15485863))) % len(rows)]
                n, pos = want.get((d, x), (0, 0))
                want[d, x] = n + 1, pos + y
    monkeypatch.setattr(resampling, "SLOTS", 100)
    monkeypatch.setattr(resampling, "UNIT_SLOTS", 700)
    for most_runs in (joins.MOST_RUNS, 60, 0):
        found = joins.row_draws(h, 20, most_runs=most_runs)
        assert {(r["draw"], r["score"]): (r["n"], r["pos"]) for r in found.collect()} == want
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and ("Join" in plan) == (most_runs < 100)


@pytest.mark.parametrize("grid", [ranking.GRID, [0.05, 0.3, 0.31, 0.8]])
def test_the_best_tau_against_trying_all(spark, grid):
    rng = random.Random(6)
    rows = [(g, rng.choice([0.0, 0.004, 0.01, 0.015, 0.3, 0.99, 1.0, *[round(rng.random(), 3) for _ in range(4)], *grid[:2]]), rng.random() < 0.3) for g in range(40) for _ in range(rng.randrange(1, 30))]
    rows += [(90, 0.5, True), (91, 0.5, False), (92, 0.001, True), (92, 0.0, False), (93, 0.2, True), (93, 0.0001, False)]
    df = spark.createDataFrame([(g, s, int(y)) for g, s, y in rows], "g int, score double, y int")
    got = {r["g"]: (r["tau"], r["f1"]) for r in ranking.f1_threshold(df, ["g"], grid).collect()}
    for g in {r[0] for r in rows}:
        own = [(s, y) for gg, s, y in rows if gg == g]
        if len({y for _, y in own}) == 1:
            assert got[g] == (0.5, 0.0)
            continue
        f1 = [2 * sum(y for s, y in own if s >= t) / (sum(1 for s, _ in own if s >= t) + sum(y for _, y in own)) for t in grid]
        assert got[g] == (grid[f1.index(max(f1))], pytest.approx(max(f1))), g


def test_metrics_of_draws_agree_with_the_single_ones(spark):
    rng = random.Random(8)
    pairs = [(int(rng.random() < 0.3), rng.randrange(15) / 15) for _ in range(300)]
    df = spark.createDataFrame([(y, s) for y, s in pairs], "y int, score double")
    h = joins.score_histogram(df, "score", "y").selectExpr("0 AS draw", "*")
    got = ranking.draw_metrics(h).first()
    assert got["ap"] == pytest.approx(ranking.average_precision(df).first()["ap"])
    assert got["auc"] == pytest.approx(ranking.roc_auc(df).first()["auc"])
    assert got["f1"] == pytest.approx(ranking.confusion(df).first()["f1"])


@pytest.mark.parametrize("block", [2, 2048])
def test_counts_of_draws_have_the_moments_of_a_multinomial(spark, block):
    from steplens.operators.resampling import row_counts

    runs = [(1, 0.9, 4, 3), (1, 0.5, 20, 0), (1, 0.1, 36, 2), (2, 0.5, 10, 10), (2, 0.7, 1, 0)] + [(3, s / 100, 5, s % 6) for s in range(40)]
    h = spark.createDataFrame(runs, "step int, score double, n long, pos long")
    rows = row_counts(h, 1500, block_scores=block).collect()
    again = row_counts(h.repartition(3), 1500, block_scores=block).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    by = {(r["draw"], r["step"], r["score"]): (r["n"], r["pos"]) for r in rows}
    n = np.array([[by.get((d, s, x), (0, 0))[0] for s, x, _, _ in runs] for d in range(1500)])
    pos = np.array([[by.get((d, s, x), (0, 0))[1] for s, x, _, _ in runs] for d in range(1500)])
    step = np.array([r[0] for r in runs])
    for s in (1, 2, 3):
        assert (n[:, step == s].sum(axis=1) == sum(r[2] for r in runs if r[0] == s)).all()
    assert (pos <= n).all()
    total = np.array([sum(r[2] for r in runs if r[0] == s) for s in step])
    for got, m in ((n, np.array([r[2] for r in runs])), (pos, np.array([r[3] for r in runs]))):
        var = m * (1 - m / total)
        assert (np.abs(got.mean(axis=0) - m) < 4.5 * np.sqrt(var / 1500) + 1e-9).all()
        assert (np.abs(got.var(axis=0) - var) < 0.3 * var + 1e-9).all()
    link = np.corrcoef(n[:, 0], n[:, 2])[0, 1]  # scores of one step share its rows
    assert link == pytest.approx(-np.sqrt(4 * 36 / (56 * 24)), abs=0.1)


def test_keyed_permutations_are_bijections(spark):
    from pyspark.sql import functions as F

    sizes = [*range(1, 60), 97, 100, 1000, 1023, 1025]
    df = spark.createDataFrame([(n, s) for n in sizes for s in (0, 1, 77)], "size long, seed long").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)).alias("place"))
    df = df.withColumns({name: F.expr(text) for name, text in joins.grid("size")}).withColumn("to", F.expr(joins.permuted("place", "size", "seed")))
    got = {}
    for r in df.collect():
        got.setdefault((r["size"], r["seed"]), {})[r["place"]] = r["to"]
    assert all(sorted(p.values()) == list(range(n)) for (n, _), p in got.items())
    assert got[1000, 1] != got[1000, 77]
    for n, s in ((1000, 1), (1025, 77)):
        p = np.array([got[n, s][i] for i in range(n)])
        assert abs(np.corrcoef(np.arange(n), p)[0, 1]) < 0.15 and np.mean(p == np.arange(n)) < 0.02 and abs(np.corrcoef(p[:-1], p[1:])[0, 1]) < 0.15
