"""Calibrated cases, negative controls and brute force on small inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from steplens.operators import drift, graph, integrity, monitor, profile, ranking, rows
from steplens.operators.components import connected_components
from steplens.operators.joins import asof_prior_snapshot


def long(spark, values, feature="x"):
    return spark.createDataFrame([(feature, float(v)) for v in values], "feature string, value double")


def psi_of(spark, a, b):
    found = drift.psi(long(spark, a), long(spark, b)).collect()
    return found[0]["psi"] if found else None


@pytest.mark.parametrize("shift,low,high", [(0, 0, 0.02), (0.5, 0.15, 0.35), (1, 0.70, 1.20), (2, 2.5, 4.5)])
def test_psi_of_shifted_normals(spark, shift, low, high):
    rng = np.random.default_rng(1)
    assert low <= psi_of(spark, rng.normal(0, 1, 5000), rng.normal(shift, 1, 5000)) <= high


def test_psi_of_constants_and_nan(spark):
    assert psi_of(spark, [1.0] * 50, [1.0] * 50) == 0
    assert psi_of(spark, [1.0] * 50, [2.0] * 50) == float("inf")
    nan = float("nan")
    assert psi_of(spark, [1.0, 2.0, 3.0, nan] * 20, [1.0, 2.0, 3.0, nan, float("inf")] * 20) == pytest.approx(0, abs=1e-9)
    assert psi_of(spark, [1.0, 2.0], [nan]) is None


def test_ks_against_brute_force(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 20, 300) / 4, rng.integers(3, 24, 200) / 4
    df = long(spark, a).withColumn("s", F.lit(0)).unionByName(long(spark, b).withColumn("s", F.lit(1)))
    want = max(abs((a <= v).mean() - (b <= v).mean()) for v in np.concatenate([a, b]))
    got = drift.ks_two_sample(df, "s").first()
    assert got["ks"] == pytest.approx(want) and 0 <= got["p_value"] <= 1


def scored(spark, pairs):
    return spark.createDataFrame([(i, y, float(s)) for i, (y, s) in enumerate(pairs)], "tx_id long, y int, score double")


def test_curves_against_brute_force_with_ties(spark):
    rng = random.Random(3)
    pairs = [(rng.random() < 0.3 and 1 or 0, rng.randrange(12) / 12) for _ in range(200)] + [(None, 0.5)] * 5
    df, known = scored(spark, pairs), [(y, s) for y, s in pairs if y is not None]
    p = sum(y for y, _ in known)
    ap = before = 0.0
    for cut in sorted({s for _, s in known}, reverse=True):
        tp, n = sum(y for y, s in known if s >= cut), sum(1 for _, s in known if s >= cut)
        ap, before = ap + (tp / p - before) * tp / n, tp / p
    assert ranking.average_precision(df).first()["ap"] == pytest.approx(ap)
    wins = [(s > r) + (s == r) / 2 for y, s in known if y for z, r in known if not z]
    assert ranking.roc_auc(df).first()["auc"] == pytest.approx(sum(wins) / len(wins))
    best = max(2 * sum(y for y, s in known if s >= c) / (sum(1 for _, s in known if s >= c) + p) for c in {s for _, s in known})
    assert ranking.oracle_f1(df).first()["oracle_f1"] == pytest.approx(best)


def test_one_class_only(spark):
    df = scored(spark, [(0, 0.1), (0, 0.9)])
    assert ranking.roc_auc(df).first()["auc"] == 0.5 and ranking.average_precision(df).first()["ap"] is None
    assert ranking.pr_auc_trapezoid(df).first()["pr_auc"] == 0 and ranking.f1_threshold(df).first()["tau"] == 0.5


def test_asof_is_strict_against_brute_force(spark):
    rng = random.Random(4)
    ev = [(f"a{rng.randrange(4)}", i, rng.randrange(8)) for i in range(40)]
    sn = list({(f"a{rng.randrange(4)}", rng.randrange(8)): rng.random() for _ in range(20)}.items())
    events = spark.createDataFrame(ev, "k string, id long, step int")
    snaps = spark.createDataFrame([(k, s, v) for (k, s), v in sn], "k string, step int, v double")
    got = {r["id"]: (r["prior_step"], r["prior_value"]) for r in asof_prior_snapshot(events, snaps, "k", "step", "v", ["id"]).collect()}
    for k, i, s in ev:
        past = [(t, v) for (a, t), v in sn if a == k and t < s]
        assert got[i] == (max(past) if past else (None, None))


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(500, i) for i in range(501, 540)] + [(7, 7), (900, 900)] + [(600 + i, 601 + i) for i in range(40)]
    parent = {n: n for e in edges for n in e}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame([*edges, (None, 3), (4, None)], "a long, b long")
    assert {r["node"]: r["component"] for r in connected_components(df, "a", "b").collect()} == {n: root(n) for n in parent}
    assert connected_components(df.limit(0), "a", "b").count() == 0


def test_labels_are_not_used_before_they_arrive(spark):
    uses = spark.createDataFrame([(34, 35), (35, 35)], "label_step int, t int")
    assert [tuple(r) for r in monitor.label_guard(uses, 1).collect()] == [(35, 35)]
    with pytest.raises(Exception, match="before its arrival"):
        monitor.assert_label_arrival(uses, 1).collect()


def test_a_crash_is_not_hidden_by_pooling(spark):
    rows_ = [(42, 1, 0.9)] * 239 + [(42, 0, 0.05)] * 1900 + [(43, 1, 0.05)] * 24 + [(43, 0, 0.05)] * 300 + [(44, 1, 0.9)] * 5
    df = spark.createDataFrame(rows_, "step int, y int, score double")
    at = spark.createDataFrame([(43,), (44,), (45,)], "step int")
    got = {r["step"]: (r["f1_min"], r["performance_status"], r["newest_label_step"]) for r in monitor.performance_channel(df, at, 0.4).collect()}
    assert got == {43: (1.0, "OK", 42), 44: (0.0, "CRITICAL", 43), 45: (0.0, "CRITICAL", 43)}


def test_a_wide_gap_counts_steps_not_rows(spark):
    c = spark.createDataFrame([(1, 10, 1), (2, 10, 9), (9, 10, 5)], "step int, labelled int, positive int")
    got = {r["step"]: r["rolling_prevalence"] for r in monitor.prevalence_channel(c, 0.1, lag=1, width=3).collect()}
    assert got == {1: 0.1, 2: 0.1, 9: 0.1}


def decision(spark, **channel):
    base = dict(step=40, triad_extreme=0, triad_significant=0, triad_level="STABLE", triad_max=0.0, local_percent=0.0, score_psi=0.0, f1_min=0.9, rolling_prevalence=0.1, prevalence_level="STABLE", domain_auc=0.5)
    kinds = "step int, triad_extreme int, triad_significant int, triad_level string, triad_max double, local_percent double, score_psi double, f1_min double, rolling_prevalence double, prevalence_level string, domain_auc double"
    row = base | channel
    return monitor.trigger_decision(spark.createDataFrame([tuple(row.values())], kinds), 0.4).first()


def test_trigger_rules(spark):
    assert decision(spark)["action"] == "NO_ACTION"
    one = decision(spark, triad_significant=1, triad_level="SIGNIFICANT", triad_max=0.5)
    assert one["action"] == "NO_ACTION"
    assert decision(spark, triad_significant=2, triad_level="SIGNIFICANT")["primary_reason"] == "ConcentratedMacroDrift"
    assert decision(spark, domain_auc=1.0)["action"] == "RECALIBRATE_ONLY"
    both = decision(spark, score_psi=0.25, local_percent=40.0)
    assert (both["action"], both["reasons"]) == ("RETRAIN", ["ScoreShift", "DiffuseMicroDriftWarning"])
    assert decision(spark, f1_min=None, score_psi=None, rolling_prevalence=None)["action"] == "NO_ACTION"


def test_recovery_needs_the_next_eligible_steps(spark):
    ap = spark.createDataFrame([(43, 0.6), (44, 0.2), (47, 0.7), (48, 0.6), (49, 0.8)], "step int, ap double")
    assert ranking.sustained_recovery(ap).first()[0] == 47
    assert ranking.sustained_recovery(ap.where("step < 49")).first()[0] is None


def test_rows_and_reports(spark):
    df = spark.createDataFrame([("1", "x"), ("", "2"), ("NaN", None)], "a string, b string")
    good, bad = rows.row_validate(df, ["a", "b"])
    assert good.count() == 0 and sorted(sum((r["errors"] for r in bad.collect()), [])) == ["missing:a", "missing:b", "non_numeric:b", "not_finite:a"]
    assert [r[0] for r in spark.createDataFrame([("3.9",), ("x",), (None,)], "c string").select(rows.parse_step("c")).collect()] == [3, None, None]
    s = rows.batch_classify(spark.createDataFrame([(float("nan"),), (2.0,), (-1.0,)], "score double")).collect()
    assert [(r["probability"], r["predicted"]) for r in s] == [(None, 0), (1.0, 1), (0.0, 0)]
    broken = integrity.integrity_rules(spark.createDataFrame([("a", 1)], "name string, n long"), spark.createDataFrame([("a", "=", 0, "failure")], "name string, op string, bound int, kind string"))
    with pytest.raises(ValueError):
        integrity.assert_sound(broken)
    with pytest.raises(ValueError):
        rows.check_contract(df, ["b", "a"])


def test_graph_edge_cases(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("z",)], "n string")
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "b"), ("a", "q")], "s string, d string")
    deg = {r["n"]: (r["in_degree"], r["out_degree"]) for r in graph.degrees(nodes, edges, "n", "s", "d").collect()}
    assert deg == {"a": (0, 3), "b": (3, 1), "z": (0, 0)}
    m = graph.edge_multiplicity(edges, "s", "d").first()
    assert (m["edges"], m["unique_pairs"], m["repeated"], m["self_loops"], m["reciprocal"]) == (4, 3, 1, 1, 1)
    assert sorted(tuple(r) for r in graph.isolated_nodes(nodes, edges, "n", "s", "d").collect()) == [("q", "outside"), ("z", "isolated")]


def test_skew_is_sample_adjusted(spark):
    x = [1.0, 2.0, 2.0, 7.0, 9.0]
    n, a = len(x), np.array(x)
    g = ((a - a.mean()) ** 3).mean() / ((a - a.mean()) ** 2).mean() ** 1.5
    got = profile.sample_quantiles(spark.createDataFrame([(v,) for v in x], "x double"), ["x"]).first()
    assert got["skew"] == pytest.approx(g * np.sqrt(n * (n - 1)) / (n - 2)) and got["p50"] == 2.0
