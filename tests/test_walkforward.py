"""Walk-forward models, their thresholds and schedules against plain readings, and channels that must stay silent."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from steplens.operators import discriminant, models, monitor
from steplens.operators import walkforward as W


def labelled(spark, steps=12, n=60, flip=8):
    """Rows whose first feature tells the label up to step ``flip`` and says the opposite after it."""
    rng = random.Random(3)
    rows = []
    for s in range(1, steps + 1):
        for i in range(n):
            y = int(rng.random() < 0.4)
            rows.append((s * 1000 + i, s, None if i % 10 == 9 else y, (y if s <= flip else 1 - y) + rng.gauss(0, 0.4), rng.gauss(0, 1)))
    return rows, spark.createDataFrame(rows, "tx_id long, step int, y int, a double, b double")


def counts_of(df):
    return df.groupBy("step").agg(F.count("y").alias("labelled"), F.count_if(F.col("y") == 1).alias("positive"))


def plain_model(rows, first, last):
    own = [r for r in rows if first <= r[1] <= last and r[2] is not None]
    w, c = [], 0.0
    for k in (3, 4):
        x1, x0 = (np.array([r[k] for r in own if r[2] == y]) for y in (1, 0))
        pooled = (len(x1) * x1.var() + len(x0) * x0.var()) / (len(x1) + len(x0))
        w.append((x1.mean() - x0.mean()) / pooled)
        c -= w[-1] * (x1.mean() + x0.mean()) / 2
    return lambda r: 1 / (1 + math.exp(-(c + w[0] * r[3] + w[1] * r[4])))


def test_one_use_against_a_plain_reading(spark):
    rows, df = labelled(spark)
    plan = spark.createDataFrame([("expanding", 1, 7, 1, 6, False), ("expanding", 2, 7, 1, 5, False), ("short", 1, 2, 1, 1, False)], "policy string, lag int, t int, first int, last int, weighted boolean")
    scored, uses = W.walk_forward(df, plan, counts_of(df), ["a", "b"])
    use = {(r["policy"], r["lag"]): r for r in uses.collect()}
    assert (use["expanding", 1]["fit_last"], use["expanding", 1]["holdout"]) == (4, 2) and use["short", 1]["holdout"] == 0
    assert use["short", 1]["tau"] == 0.5 and use["short", 1]["holdout_ap"] is None
    fit = plain_model(rows, 1, 4)
    held = [(fit(r), r[2]) for r in rows if 5 <= r[1] <= 6 and r[2] is not None]
    grid = [round(0.01 + 0.005 * i, 3) for i in range(197)]
    f1 = [2 * sum(y for s, y in held if s >= t) / (sum(s >= t for s, _ in held) + sum(y for _, y in held)) for t in grid]
    assert use["expanding", 1]["tau"] == grid[f1.index(max(f1))]
    again = plain_model(rows, 1, 6)
    got = {r["tx_id"]: r["score"] for r in scored.where("policy = 'expanding' AND lag = 1").collect()}
    assert got == {r[0]: pytest.approx(again(r), abs=1e-8) for r in rows if r[1] == 7}
    audit = W.use_audit(uses).collect()
    assert {(r["policy"], r["lag"]): r["violations"] for r in audit} == {("expanding", 1): 0, ("expanding", 2): 0, ("short", 1): 1}
    late = plan.withColumn("last", F.col("t"))
    assert all(r["leak"] and r["violations"] >= 2 for r in W.use_audit(W.plan_uses(late, counts_of(df))).collect())


def test_a_triggered_policy_fits_anew_after_its_own_crash(spark):
    _, df = labelled(spark, steps=14, flip=8)
    scored, plan = W.monitor_triggered_policy(df, counts_of(df), ["a", "b"], 6, 14, 0.6)
    schedule = {r["step"]: r["made"] for r in plan.collect()}
    # Labels of step 9, the first of the other kind, arrive for the decision at 10: the model of 11 is new.
    assert [schedule[s] for s in range(6, 11)] == [6] * 5 and schedule[11] == 11
    assert all(schedule[s] <= s for s in schedule)
    assert scored.count() == df.where("step BETWEEN 6 AND 14").count()
    _, still = W.monitor_triggered_policy(df, counts_of(df), ["a", "b"], 6, 14, 0.0)
    assert {r["made"] for r in still.collect()} == {6}


def test_scaled_logistic_regression_against_gradient_descent(spark):
    rows, df = labelled(spark, steps=3, n=50)
    model = models.linear_model(df, ["a", "b"], reg=0.1)
    got = {r["tx_id"]: r["score"] for r in models.model_score(model, df).collect()}
    known = [r for r in rows if r[2] is not None]
    x, y = np.array([r[3:] for r in known]), np.array([r[2] for r in known])
    scale = x.std(axis=0, ddof=1)
    z, weight = (x - x.mean(axis=0)) / scale, np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    w, c = np.zeros(2), 0.0
    # The penalty is on weights of features of deviation one under the balanced weights.
    mean = (weight[:, None] * z).sum(axis=0) / weight.sum()
    inner = np.sqrt((weight[:, None] * (z - mean) ** 2).sum(axis=0) / weight.sum())
    for _ in range(6000):
        p = 1 / (1 + np.exp(-(z @ w + c)))
        e = weight * (p - y) / weight.sum()
        w, c = w - 0.5 * (z.T @ e + 0.1 * w * inner**2), c - 0.5 * e.sum()
    for r in rows:
        assert got[r[0]] == pytest.approx(1 / (1 + math.exp(-(((np.array(r[3:]) - x.mean(axis=0)) / scale) @ w + c))), abs=0.02)
    flagged = models.batch_score(model, df, 0.5).collect()
    assert all(r["predicted"] == (got[r["tx_id"]] >= 0.5) for r in flagged)


def test_the_domain_classifier_and_its_least_size(spark):
    rng = random.Random(4)
    rows = [(i, s, rng.gauss(3 if s == 40 else 0, 1), rng.gauss(0, 1)) for i, s in enumerate([1, 2, 3] * 60 + [40] * 60 + [45] * 60 + [49] * 5)]
    df = spark.createDataFrame(rows, "id long, step int, a double, b double")
    at = spark.createDataFrame([(40,), (45,), (49,), (50,)], "step int")
    got = {r["step"]: r for r in discriminant.domain_auc(df, ["a", "b"], at, 34, "id").collect()}
    assert set(got) == {40, 45, 49}
    assert got[40]["domain_auc"] > 0.95 and got[40]["level"] == "ALERT" and 0.35 < got[45]["domain_auc"] < 0.65
    assert got[49]["domain_auc"] == 0.5 and got[49]["n_target"] == 5


def test_score_shift_needs_two_labelled_steps(spark):
    rng = random.Random(5)
    rows = [(s, int(rng.random() < 0.1) if s in (35, 36, 38) else None, rng.random() ** 3 if s < 40 else rng.random() ** 0.3) for s in (35, 36, 37, 38, 40) for _ in range(400)]
    df = spark.createDataFrame(rows, "step int, y int, score double")
    at = spark.createDataFrame([(36,), (37,), (38,), (40,), (41,)], "step int")
    got = {r["step"]: r for r in monitor.score_shift_channel(df, at, [i / 10 for i in range(1, 10)]).collect()}
    assert {s: r["status"] for s, r in got.items()} == {36: "UNAVAILABLE", 37: "OK", 38: "OK", 40: "CRITICAL", 41: "UNAVAILABLE"}
    assert got[36]["psi"] is None and got[40]["psi"] > 0.25


def test_streaks_of_local_drift(spark):
    df = spark.createDataFrame([(35, 40.0), (36, 31.0), (37, 10.0), (38, None), (39, 30.0)], "step int, local_percent double")
    assert {r["step"]: r["streak"] for r in monitor.local_streak(df).collect()} == {35: 1, 36: 2, 37: 0, 38: 0, 39: 1}


def test_rows_alike_are_scored_once_and_equal_models_share_their_scores(spark):
    _, df = labelled(spark)
    df = df.withColumn("a", F.round("a", 1)).withColumn("b", F.lit(0.5))
    many = df.withColumn("tx_id", F.explode(F.array(*[F.col("tx_id") + 1_000_000 * k for k in range(5)])))
    plan = spark.createDataFrame([("expanding", k, t, 1, t - k, False) for k in (1, 2) for t in (6, 7)] + [("static", k, 7, 1, 4, False) for k in (1, 2)], "policy string, lag int, t int, first int, last int, weighted boolean")
    scored, uses = W.walk_forward(many, plan, counts_of(many), ["a", "b"])
    h, shared = W.walk_counts(many, plan, counts_of(many), ["a", "b"])
    models_of = {(r["policy"], r["lag"], r["t"]): r["model"] for r in shared.collect()}
    assert models_of["static", 1, 7] == models_of["static", 2, 7] and len(set(models_of.values())) == 5
    want = {(r["policy"], r["lag"], r["step"], r["score"]): (r["n"], r["pos"]) for r in scored.where("y IS NOT NULL").groupBy("policy", "lag", "step", "score").agg(F.count("*").alias("n"), F.sum("y").alias("pos")).collect()}
    got = {(r["policy"], r["lag"], r["t"], r["score"]): (r["n"], r["pos"]) for r in h.join(shared.select("policy", "lag", "t", "model"), "model").collect()}
    assert got == want
    columns = ["policy", "lag", "t", "fit_last", "last", "tau", "holdout_ap"]
    assert sorted(map(tuple, uses.select(columns).collect())) == sorted(map(tuple, shared.select(columns).collect()))
    known = W.alike(many, ["step", "y", "a", "b"])
    assert known.count() == df.where("y IS NOT NULL").select("step", "y", "a", "b").distinct().count()
    assert known.agg(F.sum("_n")).first()[0] == many.where("y IS NOT NULL").count()


def test_no_row_meets_models_of_other_steps(spark):
    _, df = labelled(spark, steps=14)
    scored, _ = W.monitor_triggered_policy(df, counts_of(df), ["a", "b"], 6, 14, 0.6)
    assert "NestedLoop" not in scored._jdf.queryExecution().executedPlan().toString()
