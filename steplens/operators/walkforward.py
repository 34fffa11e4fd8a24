"""Walk-forward evaluation: for each policy, label lag and step a linear model is fitted on labels that have arrived, its
threshold is chosen on a hold-out of the newest of them, it is fitted again on all, and the step is scored. Models are closed
forms over moments of steps, so every one of them comes out of one pass over the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steplens.operators import newton, ranking
from steplens.operators.models import choose_holdout
from steplens.operators.newton import alike
from steplens.sources.scratch import materialise, small


def step_moments(df: DataFrame, features: list[str], step: str = "step", y: str = "y") -> DataFrame:
    """(step, n1, n0, and for each feature m1_, v1_, m0_, v0_): what models of any range of steps are made of."""
    p, q = F.col(y) == 1, F.col(y) == 0
    cells = [f(F.when(c, F.col(x))).alias(f"{a}{i}_{x}") for x in features for i, c in ((1, p), (0, q)) for a, f in (("m", F.avg), ("v", F.var_pop))]
    return small(df.where(F.col(y).isNotNull()).groupBy(step).agg(F.count_if(p).alias("n1"), F.count_if(q).alias("n0"), *cells), "moments")


def plan_uses(plan: DataFrame, counts: DataFrame, least: int = 40, low: int = 2, high: int = 6, step: str = "step") -> DataFrame:
    """``plan`` (policy, lag, t, first, last, weighted) with holdout, the number of newest training steps that are held out
    (as few as hold ``least`` positives), and fit_last, the newest step of the first fit: never before ``first``."""
    decided = plan.select(F.col("last").alias("_last")).distinct()
    held = choose_holdout(counts, decided.select((F.col("_last") + 1).alias(step)), 1, least, low, high, step).select((F.col("t") - 1).alias("_last"), "holdout")
    out = plan.join(held, plan["last"] == held["_last"], "left").drop("_last")
    fit_last = F.greatest(F.col("first"), F.col("last") - F.coalesce("holdout", F.lit(low)))
    return out.withColumn("fit_last", fit_last.cast("int")).withColumn("holdout", F.col("last") - F.col("fit_last"))


def models(uses: DataFrame, moments: DataFrame, features: list[str], last: str, half_life: float, step: str = "step", dropped: Sequence[str] = ()) -> DataFrame:
    """(policy, lag, t, w, c): weights and constant of the model of steps first..``last`` of each use; steps weigh 0.5 **
    (age / half-life) where the policy is weighted. Both classes weigh the same. Null where one class is missing. Uses that are
    ``ablated`` give the ``dropped`` features no weight, which is the model without them, as no weight depends on another's."""
    own = uses.join(moments, F.col(step).between(F.col("first"), F.col(last)))
    a = F.when(F.col("weighted"), F.pow(F.lit(0.5), (F.col(last) - F.col(step)) / F.lit(half_life))).otherwise(F.lit(1.0))
    own = own.withColumns({"_a1": a * F.col("n1"), "_a0": a * F.col("n0")})

    def mean(x: str, i: int) -> Column:
        return F.sum(F.col(f"_a{i}") * F.coalesce(f"m{i}_{x}", F.lit(0.0))) / F.sum(f"_a{i}")

    def square(x: str, i: int) -> Column:
        return F.sum(F.col(f"_a{i}") * (F.coalesce(f"v{i}_{x}", F.lit(0.0)) + F.pow(F.coalesce(f"m{i}_{x}", F.lit(0.0)), 2)))

    cells = [c for x in features for c in (mean(x, 1).alias(f"_m1_{x}"), mean(x, 0).alias(f"_m0_{x}"), square(x, 1).alias(f"_s1_{x}"), square(x, 0).alias(f"_s0_{x}"))]
    ablated = F.col("ablated") if dropped else F.lit(False)
    sums = own.withColumn("_ablated", ablated).groupBy("policy", "lag", "t", "_ablated").agg(F.sum("_a1").alias("_n1"), F.sum("_a0").alias("_n0"), *cells).where("_n1 > 0 and _n0 > 0")

    def weight(x: str) -> Column:
        pooled = (F.col(f"_s1_{x}") - F.col("_n1") * F.pow(F.col(f"_m1_{x}"), 2) + F.col(f"_s0_{x}") - F.col("_n0") * F.pow(F.col(f"_m0_{x}"), 2)) / (F.col("_n1") + F.col("_n0"))
        kept = (pooled > 0) & ~F.col("_ablated") if x in dropped else pooled > 0
        return F.coalesce(F.when(kept, (F.col(f"_m1_{x}") - F.col(f"_m0_{x}")) / pooled), F.lit(0.0))

    w = F.array(*[weight(x) for x in features])
    middle = F.array(*[(F.col(f"_m1_{x}") + F.col(f"_m0_{x}")) / 2 for x in features])
    out = sums.select("policy", "lag", "t", w.alias("w"), middle.alias("_c"))
    return out.select("policy", "lag", "t", "w", (-F.aggregate(F.zip_with("w", "_c", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)).alias("c"))


def logistic_models(rows: DataFrame, uses: DataFrame, features: list[str], half_life: float, step: str = "step", y: str = "y") -> tuple[DataFrame, DataFrame]:
    """The same by logistic regressions, which see how features go together: the models of first..fit_last and of first..last of each
    use. Windows that several uses share are fitted once, all of them in the same passes."""
    plan = uses.select("first", "fit_last", "last", "weighted").collect()  # one row a policy, lag and step
    ends = [(r["first"], last, r["weighted"]) for r in plan for last in (r["fit_last"], r["last"]) if last is not None and last >= r["first"]]
    fits = small(newton.fit_windows(rows, ends, features, half_life, step, y), "logistic")

    def of(last: str) -> DataFrame:
        own = fits.select(F.col("first").alias("_f"), F.col("last").alias("_l"), F.col("weighted").alias("_w"), "w", "c")
        return uses.join(own, (uses["first"] == own["_f"]) & (uses[last] == own["_l"]) & (uses["weighted"] == own["_w"])).select("policy", "lag", "t", "w", "c")

    return of("fit_last"), of("last")


def _scored(rows: DataFrame, features: list[str]) -> Column:
    margin = sum((F.get("w", F.lit(i)) * F.col(x) for i, x in enumerate(features)), F.col("c"))
    return F.round(1 / (1 + F.exp(F.least(F.greatest(-margin, F.lit(-500.0)), F.lit(500.0)))), 9)


def _score_counts(known: DataFrame, uses: DataFrame, same: list[str], scores: Column, features: list[str], step: str, y: str) -> tuple[DataFrame, DataFrame]:
    """(h, of). ``of``: (policy, lag, t, model): uses (policy, lag, t, w, c) that are equal in ``same`` have one model, which scores the
    steps ``scores``, an array. ``h``: (model, score, n, pos), written, over the rows of ``known``, counted in ``_n``."""
    named = small(uses.withColumn("model", F.dense_rank().over(Window.orderBy(*same))), "named")  # one row a policy, lag and step
    own = named.select("model", "w", "c", F.explode(scores).alias(step)).distinct()
    each = known.join(F.broadcast(own), step)
    each = each.withColumn("score", _scored(each, features)).where("score IS NOT NULL")
    h = each.groupBy("model", "score").agg(F.sum("_n").alias("n"), F.sum(F.col("_n") * F.col(y)).cast("long").alias("pos"))
    return materialise(h, "scores"), named.select("policy", "lag", "t", "model")


def _walk(df: DataFrame, plan: DataFrame, counts: DataFrame, features: list[str], step: str, y: str, half_life: float, least: int, fallback: float, logistic: bool, dropped: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(known, again, chosen): labelled rows of the steps that any model scores, rows that are alike counted once; models fitted anew; and
    uses with their thresholds."""
    by = ["policy", "lag", "t"]
    uses = small(plan_uses(plan.where(F.col("first") <= F.col("last")), counts, least, step=step), "uses")
    if logistic:
        fitted, again = logistic_models(df, uses, features, half_life, step, y)
    else:
        moments = step_moments(df, features, step, y)
        fitted, again = (models(uses, moments, features, last, half_life, step, dropped) for last in ("fit_last", "last"))
    fitted, again = small(fitted, "fitted"), small(again, "refitted")
    # A hold-out is named by its steps, few of them, so rows meet the models of their own step alone.
    held = F.when(F.col("last") > F.col("fit_last"), F.sequence(F.col("fit_last") + 1, F.col("last")))
    wanted = small(uses.select(F.explode(F.concat(F.coalesce(held, F.array().cast("array<int>")), F.array("t"))).alias(step)).distinct(), "wanted")
    known = alike(df.join(F.broadcast(wanted), step, "left_semi"), [step, y, *features], y)
    h, of = _score_counts(known, uses.join(fitted, by).where("last > fit_last").select(*by, "fit_last", "last", "w", "c"), ["fit_last", "last", "w", "c"], held, features, step, y)
    tau = ranking.best_tau(h, ["model"], fallback=fallback).select("model", "tau")
    ap = ranking.ap_of(ranking.cumulative_curve(h, ["model"]), ["model"]).select("model", F.col("ap").alias("holdout_ap"))
    chosen = uses.join(of, by, "left").join(tau, "model", "left").join(ap, "model", "left").withColumn("tau", F.coalesce("tau", F.lit(fallback))).drop("model")
    return known, again, small(chosen, "chosen")


def walk_forward(df: DataFrame, plan: DataFrame, counts: DataFrame, features: list[str], step: str = "step", key: str = "tx_id", y: str = "y", half_life: float = 5.0, least: int = 40, fallback: float = 0.5, logistic: bool = False, dropped: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(scored, uses). ``scored``: (policy, lag, step, key, y, score), every step of the plan scored by the model fitted anew on
    all arrived labels of its range. ``uses``: one row a model, with first, last, fit_last, holdout, tau, the threshold of
    best F1 on the hold-out under the model that has not seen it, and holdout_ap. ``plan`` and ``counts`` are tables of steps.
    Uses that are ``ablated`` in the plan do without the ``dropped`` features, in the same walk. ``logistic`` takes logistic regressions in place of the closed form, which looks at each feature by itself."""
    _, again, chosen = _walk(df, plan, counts, features, step, y, half_life, least, fallback, logistic, dropped)
    rows = df.select(key, step, y, *features)
    now = rows.join(F.broadcast(again.select("policy", "lag", F.col("t").alias(step), "w", "c")), step)
    return now.withColumn("score", _scored(now, features)).select("policy", "lag", step, key, y, "score"), chosen


def walk_counts(df: DataFrame, plan: DataFrame, counts: DataFrame, features: list[str], step: str = "step", y: str = "y", half_life: float = 5.0, least: int = 40, fallback: float = 0.5, logistic: bool = False, dropped: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The same walk where rows themselves are not asked for: (h, uses). ``h``: (model, score, n, pos), the labelled rows and positives of
    each distinct score, written. ``uses`` as above, with the ``model`` that has scored its step; uses of equal models share it."""
    by = ["policy", "lag", "t"]
    known, again, chosen = _walk(df, plan, counts, features, step, y, half_life, least, fallback, logistic, dropped)
    h, of = _score_counts(known, again, ["t", "w", "c"], F.array("t"), features, step, y)
    return h, chosen.join(of, by, "left")


def realised(h: DataFrame, uses: DataFrame, step: str = "step") -> DataFrame:
    """One row a use of ``walk_counts`` with AP, AUC and F1 at its own threshold on the step that it scored, beside what the hold-out promised."""
    curve = ranking.ap_auc_of(ranking.cumulative_curve(h, ["model"]), ["model"])
    cuts = uses.where("model IS NOT NULL").select("model", "tau").distinct()
    hit = F.col("score") >= F.col("tau")
    f1 = h.join(F.broadcast(cuts), "model").groupBy("model", "tau").agg(ranking.ratio(2 * F.sum(F.when(hit, F.col("pos")).otherwise(0)), F.sum(F.when(hit, F.col("n")).otherwise(0)) + F.sum("pos")).alias("f1"))
    return uses.withColumnRenamed("t", step).join(curve, "model", "left").join(f1, ["model", "tau"], "left")


def policy_gap(table: DataFrame, frozen: str, moving: str, lag: int, value: str = "ap", step: str = "step") -> DataFrame:
    """(step, frozen, moving, delta): what two policies have realised on each step that both have scored, one row a use in ``table``."""
    a, b = (table.where((F.col("policy") == p) & (F.col("lag") == lag)).select(step, F.col(value).alias(p)) for p in (frozen, moving))
    return a.join(b, step).withColumn("delta", F.col(moving) - F.col(frozen))


def refit_actions(schedule: DataFrame, step: str = "step") -> DataFrame:
    """The decision sequence of a schedule: a step that has a new model was decided to be retrained for."""
    return schedule.select(step, F.when(F.col("refitted"), "RETRAIN").otherwise("NO_ACTION").alias("action"))


def lag_curve(h: DataFrame, uses: DataFrame, lags: list[int], frozen: str, moving: str, window: tuple[int, int]) -> DataFrame:
    """(lag, frozen, moving, delta): AP over a window's rows pooled, under a policy that stands still and one that moves on."""
    by = ["lag", "policy"]
    late = uses.where(F.col("t").between(*window) & F.col("lag").isin(lags) & F.col("policy").isin(frozen, moving)).select(*by, "model")
    pooled = h.join(F.broadcast(late), "model").groupBy(*by, "score").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    p = ranking.ap_of(ranking.cumulative_curve(materialise(pooled, "pooled"), by), by).groupBy("lag").pivot("policy", [frozen, moving]).agg(F.max("ap"))
    return p.select("lag", frozen, moving, (F.col(moving) - F.col(frozen)).alias("delta"))


def recovery_verdict(curve: DataFrame, moving: str, prompt: int, late: int, floor: float = 0.5) -> DataFrame:
    """Whether the moving policy recovers with prompt labels, and whether late ones lose half of that."""
    c = curve.agg(F.max(F.when(F.col("lag") == prompt, F.col(moving))).alias("best"), F.max(F.when(F.col("lag") == late, F.col(moving))).alias("slow"))
    a, b = F.col("best") >= floor, F.col("slow") < F.col("best") / 2
    return c.select(a.alias("recovers"), b.alias("delay_matters"), F.when(a & b, "recovers only with prompt labels").when(a, "recovers").otherwise("does not recover").alias("verdict"))


def holdout_vs_realised(table: DataFrame) -> DataFrame:
    """Correlation of what hold-outs promised with what the scored steps gave, over uses that have both."""
    own = table.where("holdout_ap IS NOT NULL AND ap IS NOT NULL")
    fit = (F.count("*") >= 3) & (F.countDistinct("holdout_ap") > 1) & (F.countDistinct("ap") > 1)
    return own.agg(F.count("*").alias("n"), F.when(fit, F.corr("holdout_ap", "ap")).alias("r"))


def use_audit(uses: DataFrame) -> DataFrame:
    """For each use of a model the newest label it has seen, when that arrived, whether that was too late, its hold-out steps,
    and how many rules it breaks: labels not arrived, the scored step in training, a hold-out in the first fit, no hold-out."""
    arrival = F.col("last") + F.col("lag")
    broken = [arrival > F.col("t"), F.col("last") >= F.col("t"), F.col("fit_last") >= F.col("last"), F.col("fit_last") < F.col("first")]
    return uses.select("policy", "lag", "t", "first", "fit_last", "last", "holdout", arrival.alias("arrival"), broken[0].alias("leak"), sum((b.cast("int") for b in broken), F.lit(0)).alias("violations"))


def monitor_triggered_policy(df: DataFrame, counts: DataFrame, features: list[str], first: int, last: int, floor: float, lag: int = 1, newest: int = 2, least_positives: int = 10, step: str = "step", key: str = "tx_id", y: str = "y", least: int = 40) -> tuple[DataFrame, DataFrame]:
    """(scored, schedule): steps first..last scored by a model that is fitted anew when its own performance falls under the
    floor. F1 of every model that the policy may come to use on every step is one table, of steps by steps; the schedule
    follows from it: at step t the worst F1 of the ``newest`` arrived steps with enough positives that the model in force has scored
    decides whether the next step has a new one."""
    spark = df.sparkSession
    table = spark.createDataFrame([("triggered", lag, t, 1, t - lag, False) for t in range(first, last + 1)], "policy string, lag int, t int, first int, last int, weighted boolean")
    uses = small(plan_uses(table, counts, least, step=step), "uses")
    rows = df.select(key, step, y, *features)
    _, chosen = walk_forward(df, table, counts, features, step, key, y, least=least)  # its scored rows are not worked out
    taus = {r["t"]: r["tau"] for r in chosen.select("t", "tau").collect()}  # one row a step
    again = small(models(uses, step_moments(rows, features, step, y), features, "last", 5.0, step), "models")
    # A model made at a step scores that step and later ones, never an earlier one: half of all steps by steps.
    force = again.select(F.col("t").alias("made"), "w", "c").join(chosen.select(F.col("t").alias("made"), "tau"), "made").withColumn(step, F.explode(F.sequence("made", F.lit(last))))
    every = rows.join(F.broadcast(force), step)  # half of all steps by steps
    every = every.withColumn("score", _scored(every, features)).select(key, step, y, "made", "tau", "score")
    f1 = {(r["made"], r[step]): (r["f1"], r["tp"] + r["fn"]) for r in ranking.confusion(every, ["made", step], y=y, tau="tau").collect()}  # steps x steps
    made, schedule, since = first, [], first
    for t in range(first, last + 1):
        schedule.append((t, made, taus.get(made), t == since and t > first))
        judged = [f1[made, s][0] for s in range(since, t - lag + 1) if (made, s) in f1 and f1[made, s][1] >= least_positives][-newest:]
        if judged and min(judged) < floor:
            made = since = t + 1
    plan = spark.createDataFrame(schedule, f"{step} int, made int, tau double, refitted boolean")
    scored = every.select(key, step, y, "made", "score").join(F.broadcast(plan.select(step, "made")), [step, "made"])
    return scored, plan
