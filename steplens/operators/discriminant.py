"""A linear classifier in closed form, scored out of fold: weights are gaps of class means over pooled variances, so fitting
is one aggregate, any number of models at once, and any engine repeats it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steplens.operators import drift, ranking
from steplens.operators.joins import grid, permuted
from steplens.operators.prefix import positions
from steplens.sources.scratch import materialise, small


def fold_of(key: str, folds: int) -> Column:
    return F.pmod(F.col(key).cast("long"), F.lit(folds)).cast("int")


def fold_moments(rows: DataFrame, features: list[str], by: list[str], y: str = "y") -> DataFrame:
    """(by, fold, n1, n0, and for each feature m1_, v1_, m0_, v0_): each row counts once, whatever models it goes into."""
    p, q = F.col(y) == 1, F.col(y) == 0
    cells = [f(F.when(c, F.col(x))).alias(f"{a}{i}_{x}") for x in features for i, c in ((1, p), (0, q)) for a, f in (("m", F.avg), ("v", F.var_pop))]
    return rows.groupBy(*by, "fold").agg(F.count_if(p).alias("n1"), F.count_if(q).alias("n0"), *cells)


def weights_of(moments: DataFrame, features: list[str], by: list[str], folds: int) -> DataFrame:
    """(by, fold, w): the weights of each fold's model from the moments of all other folds. A feature that does not vary or a class that
    is missing weighs 0. One row a model and fold, written."""
    seen = moments.withColumn("_k", F.explode(F.filter(F.array(*[F.lit(i) for i in range(folds)]), lambda k: k != F.col("fold"))))

    def mean(x: str, i: int) -> Column:
        return F.sum(F.col(f"n{i}") * F.coalesce(f"m{i}_{x}", F.lit(0.0))) / F.nullif(F.sum(f"n{i}"), F.lit(0))

    def square(x: str, i: int) -> Column:
        return F.sum(F.col(f"n{i}") * (F.coalesce(f"v{i}_{x}", F.lit(0.0)) + F.pow(F.coalesce(f"m{i}_{x}", F.lit(0.0)), 2)))

    cells = [c for x in features for i in (1, 0) for c in (mean(x, i).alias(f"_m{i}_{x}"), square(x, i).alias(f"_s{i}_{x}"))]
    sums = seen.groupBy(*by, F.col("_k").alias("fold")).agg(F.sum("n1").alias("_n1"), F.sum("n0").alias("_n0"), *cells)

    def weight(x: str) -> Column:
        inside = sum((F.col(f"_s{i}_{x}") - F.col(f"_n{i}") * F.pow(F.col(f"_m{i}_{x}"), 2) for i in (1, 0)), F.lit(0.0))
        pooled = inside / F.nullif(F.col("_n1") + F.col("_n0"), F.lit(0))
        steady = inside > 1e-12 * (F.col(f"_s1_{x}") + F.col(f"_s0_{x}"))
        return F.coalesce(F.when(steady, (F.col(f"_m1_{x}") - F.col(f"_m0_{x}")) / pooled), F.lit(0.0))

    return small(sums.select(*by, "fold", F.array(*[weight(x) for x in features]).alias("w")), "weights")


def weights(rows: DataFrame, features: list[str], by: list[str], folds: int, y: str = "y") -> DataFrame:
    return weights_of(fold_moments(rows, features, by, y), features, by, folds)


def linear_score(features: list[str]) -> Column:
    """To nine decimals, so that equal rows tie."""
    return F.round(sum((F.get("w", F.lit(i)) * F.col(x) for i, x in enumerate(features)), F.lit(0.0)), 9)


def out_of_fold(rows: DataFrame, features: list[str], by: list[str], key: str, folds: int = 3, y: str = "y") -> DataFrame:
    """(by, key, fold, y, score): each row scored by the model that has not seen its fold."""
    own = rows.withColumn("fold", fold_of(key, folds))
    w = weights(own, features, by, folds, y)
    return own.join(F.broadcast(w), [*by, "fold"]).select(*by, key, "fold", y, linear_score(features).alias("score"))  # one row a model and fold


def domain_scores(df: DataFrame, features: list[str], targets: DataFrame, reference: Column, key: str, folds: int = 3) -> DataFrame:
    """(_t, key, fold, y, score) of the rows of each target (_t, lo, hi), steps lo to hi, y 1, and of the rows where ``reference`` holds, y 0,
    by models that tell the two apart. Moments of the reference are taken once for all targets; only its scores are made for each."""
    own = df.select(key, "_step", *features, fold_of(key, folds).alias("fold"), reference.alias("_early"))
    t = F.broadcast(targets)  # one row a target
    late = own.join(t, F.col("_step").between(F.col("lo"), F.col("hi"))).select("_t", key, "fold", F.lit(1).alias("y"), *features)
    early = own.where("_early").select(key, "fold", F.lit(0).alias("y"), *features)
    moments = fold_moments(late, features, ["_t"]).unionByName(fold_moments(early, features, []).crossJoin(F.broadcast(targets.select("_t"))))
    w = weights_of(moments, features, ["_t"], folds)
    by_fold = F.broadcast(w.groupBy("fold").agg(F.collect_list(F.struct("_t", "w")).alias("m")))  # one row a fold
    scored = early.join(by_fold, "fold").select(key, "fold", "y", *features, F.explode("m").alias("m")).select("*", "m._t", "m.w")
    both = late.join(F.broadcast(w), ["_t", "fold"]).unionByName(scored.drop("m"))
    return both.select("_t", key, "fold", "y", linear_score(features).alias("score"))


def fold_auc(scored: DataFrame, by: list[str], y: str = "y") -> DataFrame:
    """The mean over folds of the AUC."""
    return ranking.roc_auc(scored, [*by, "fold"], y=y).groupBy(*by).agg(F.avg("auc").alias("auc"))


def domain_auc(df: DataFrame, features: list[str], targets: DataFrame, reference_last: int, key: str, folds: int = 3, least: int = 10, step: str = "step") -> DataFrame:
    """(step, n_target, domain_auc, level): how well each target step's rows are told from the reference rows, the steps up to
    ``reference_last``. A step of fewer than ``least`` rows cannot be judged and has a half. Features that follow the clock are
    for the caller to leave out. ``targets`` has one row a step."""
    steps = targets.select(F.col(step).alias("_t"), F.col(step).alias("lo"), F.col(step).alias("hi"))
    scored = domain_scores(df.withColumn("_step", F.col(step)), features, steps, F.col(step) <= reference_last, key, folds)
    size = scored.groupBy("_t").agg(F.sum("y").alias("n_target"))
    auc = F.when(F.col("n_target") < least, 0.5).otherwise(F.col("auc"))
    out = size.join(fold_auc(scored, ["_t"]), "_t").where("n_target > 0").select(F.col("_t").alias(step), "n_target", auc.alias("domain_auc"))
    level = F.when(F.col("domain_auc") >= 0.85, "ALERT").when(F.col("domain_auc") >= 0.70, "MODERATE").otherwise("STABLE")
    return out.withColumn("level", level)


def domain_auc_ablation(df: DataFrame, features: list[str], drops: dict[str, list[str]], targets: DataFrame, reference_last: int, key: str, **more) -> DataFrame:
    """The same for each named set of dropped features."""
    out = None
    for name, gone in drops.items():
        one = domain_auc(df, [f for f in features if f not in gone], targets, reference_last, key, **more).withColumn("ablation", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def in_window_cv_ap(df: DataFrame, features: list[str], key: str, folds: int = 3, y: str = "y") -> DataFrame:
    """AP out of fold over labelled rows: what the labels of a window would give if they were all there."""
    scored = out_of_fold(df.where(F.col(y).isNotNull()), features, [], key, folds, y)
    return ranking.average_precision(scored, y=y)


def permutation_auc_drop(df: DataFrame, features: list[str], blocks: dict[str, list[str]], key: str, folds: int = 3, repeats: int = 3, y: str = "y") -> DataFrame:
    """(block, auc_drop, repeats): mean loss of the out-of-fold AUC when the features of a block are shuffled among the rows of
    a fold, each by itself. Rows have places in their fold, and a shuffle is a keyed permutation of the places, so a row gets
    its new value by one equal join and no window. The score is linear, so only what the shuffled features change is worked out, once
    for all blocks that hold a feature."""
    own = df.where(F.col(y).isNotNull()).select(key, F.col(y).cast("int").alias("y"), *features, fold_of(key, folds).alias("fold"))
    placed = materialise(positions(own, ["fold"], [F.col(key)], "place", "size", "folds"), "places")
    w = weights(placed, features, [], folds)
    names = {f: i for i, f in enumerate(features)}
    scored = placed.join(F.broadcast(w), "fold").withColumn("score", sum((F.get("w", F.lit(i)) * F.col(f) for f, i in names.items()), F.lit(0.0)))  # one row a fold
    used = [f for f in features if any(f in fs for fs in blocks.values())]
    tries = [F.struct(F.lit(r).alias("repeat"), F.lit(f).alias("feature"), F.lit(101 * r + names[f]).cast("long").alias("seed"), F.col(f).alias("x"), F.get("w", F.lit(names[f])).alias("wf")) for f in used for r in range(repeats)]
    sides = {name: F.expr(text) for name, text in grid("size")}
    long = scored.select(key, "fold", "y", "score", "place", "size", F.explode(F.array(*tries)).alias("t")).select(key, "fold", "y", "score", "place", "size", "t.*").withColumns(sides)
    asked = long.withColumn("from", F.expr(permuted("place", "size", "seed")))
    given = placed.select("fold", F.col("place").alias("from"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("x2")) for f in used])).alias("g")).select("fold", "from", "g.*")
    moved = asked.join(given, ["fold", "from", "feature"])
    held = F.array(*[F.struct(F.lit(b).alias("block"), F.array(*map(F.lit, fs)).alias("fs")) for b, fs in blocks.items()])
    member = moved.select(key, "fold", "y", "score", "repeat", F.expr("wf * (x2 - x)").alias("change"), F.explode(F.filter(held, lambda b: F.array_contains(b["fs"], F.col("feature")))).alias("b"))
    scores = member.groupBy(F.col("b.block").alias("block"), "repeat", key, "fold", "y").agg(F.round(F.first("score") + F.sum("change"), 9).alias("score"))
    auc = fold_auc(scores, ["block", "repeat"])
    base = fold_auc(scored.select("fold", "y", F.round("score", 9).alias("score")), []).select(F.col("auc").alias("base"))
    return auc.crossJoin(F.broadcast(base)).groupBy("block").agg(F.avg(F.col("base") - F.col("auc")).alias("auc_drop"), F.count("*").alias("repeats"))  # one row


def drift_metrics(df: DataFrame, features: list[str], windows: DataFrame, reference_last: int, key: str, y: str = "y", folds: int = 3, step: str = "step") -> DataFrame:
    """(window, domain_auc, median_ks, in_window_ap, transferred_ap) of each window (window, lo, hi): how well its rows are told from the
    reference, the steps up to ``reference_last``; the median over features of their KS distance; the AP that its own labels give
    out of fold; and the AP of a model of the reference's labels."""
    targets = windows.select(F.col("window").alias("_t"), "lo", "hi")
    reference = F.col(step) <= reference_last
    auc = fold_auc(domain_scores(df.withColumn("_step", F.col(step)), features, targets, reference, key, folds), ["_t"])
    late = df.join(F.broadcast(targets), F.col(step).between(F.col("lo"), F.col("hi"))).select("_t", key, y, *features)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features])).alias("c")
    early = df.where(reference).select(cells).select("c.*").crossJoin(F.broadcast(targets.select("_t"))).withColumn("_side", F.lit(0))  # values x windows
    ks = drift.ks_two_sample(early.unionByName(late.select("_t", cells).select("_t", "c.*").withColumn("_side", F.lit(1))), "_side", ["_t"])
    median = ks.groupBy("_t").agg(F.expr("percentile(ks, 0.5)").alias("median_ks"))  # one value a feature
    known = late.where(F.col(y).isNotNull())
    own = ranking.average_precision(out_of_fold(known, features, ["_t"], key, folds, y), ["_t"], y=y).select("_t", F.col("ap").alias("in_window_ap"))
    # all rows of the reference in fold 1 of two give fold 0 one model that has seen all of them
    learned = weights(df.where(reference & F.col(y).isNotNull()).withColumn("fold", F.lit(1)), features, [], 2, y).where("fold = 0").select("w")
    moved = known.crossJoin(F.broadcast(learned)).select("_t", F.col(y).alias("y"), linear_score(features).alias("score"))  # one row
    transferred = ranking.average_precision(moved, ["_t"]).select("_t", F.col("ap").alias("transferred_ap"))
    found = auc.select("_t", F.col("auc").alias("domain_auc")).join(median, "_t", "left").join(own, "_t", "left").join(transferred, "_t", "left")
    return found.withColumnRenamed("_t", "window")
