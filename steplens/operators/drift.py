"""Drift of distributions: PSI, KS, detrending, scores and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steplens.operators.prefix import quantiles, running_by_value
from steplens.operators.profile import spearman
from steplens.operators.rows import finite
from steplens.sources.scratch import small

#: Bounds of the levels of a drift score.
MODERATE, SIGNIFICANT = 0.10, 0.25


def drift_level(score: str | Column) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s < MODERATE, "STABLE").when(s <= SIGNIFICANT, "MODERATE").otherwise("SIGNIFICANT")


def reference_edges(long: DataFrame, bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """Distinct quantile edges of each feature's finite values, least and greatest included."""
    by = by or ["feature"]
    return quantiles(long.where(finite("value")), by, "value", [i / bins for i in range(bins + 1)], "edges").select(*by, F.array_distinct("edges").alias("edges"))


def bin_number(value: str, edges: Column) -> Column:
    """How many edges are no greater: bins are half open."""
    return F.size(F.filter(edges, lambda e: e <= F.col(value)))


def psi(reference: DataFrame, target: DataFrame, by: list[str] | None = None, bins: int = 10, floor: float = 1e-4, renormalise: bool = True, ends: str = "open", edges: DataFrame | None = None) -> DataFrame:
    """Population stability index of (feature, value) tables, for each further key ``by`` of the target.

    ``ends``: "open" counts values beyond the reference range in the outer bins; "closed" drops them; "interior" bins by
    the inner edges alone. Proportions are floored and, if asked for, made to sum to 1 again. 0 if a side is empty or the
    edges leave one bin; infinite if both sides are constant and differ.
    """
    by = by or []
    e = edges if edges is not None else reference_edges(reference, bins)
    inner = F.slice("edges", 2, F.size("edges") - 2) if ends != "interior" else F.when(F.size("edges") > 2, F.slice("edges", 2, F.size("edges") - 2)).otherwise(F.slice("edges", 2, 0))
    e = e.withColumn("inner", F.when(F.size("edges") >= 2, inner).otherwise(F.slice("edges", 1, 0))).withColumn("lo", F.get("edges", F.lit(0))).withColumn("hi", F.element_at("edges", -1))

    def shares(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        own = df.where(finite("value")).join(F.broadcast(e), "feature")  # one row a feature
        if ends == "closed":
            own = own.where("value between lo and hi")
        binned = own.groupBy(*keys, "feature", bin_number("value", F.col("inner")).alias("bin")).agg(F.count("*").alias("n"))
        return binned.withColumn(name, F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "feature"))).drop("n")

    q = shares(reference, [], "q")
    p = shares(target, by, "p")
    groups = target.where(finite("value")).groupBy(*by, "feature").agg(F.min("value").alias("t_lo"), F.max("value").alias("t_hi"))
    grid = groups.join(F.broadcast(e), "feature").select(*by, "feature", "lo", "hi", "t_lo", "t_hi", F.explode(F.sequence(F.lit(0), F.size("inner"))).alias("bin"))
    full = grid.join(q, ["feature", "bin"], "left").join(p, [*by, "feature", "bin"], "left")
    full = full.withColumn("q", F.greatest(F.coalesce("q", F.lit(0.0)), F.lit(floor))).withColumn("p", F.greatest(F.coalesce("p", F.lit(0.0)), F.lit(floor)))
    if renormalise:
        w = Window.partitionBy(*by, "feature")
        full = full.withColumn("q", F.col("q") / F.sum("q").over(w)).withColumn("p", F.col("p") / F.sum("p").over(w))
    total = F.sum((F.col("p") - F.col("q")) * F.ln(F.col("p") / F.col("q")))
    constants = (F.max("lo") == F.max("hi")) & (F.min("t_lo") == F.max("t_hi")) & (F.max("lo") != F.max("t_hi"))
    return full.groupBy(*by, "feature").agg(F.when(constants, F.lit(float("inf"))).when(F.count("*") == 1, 0.0).otherwise(total).alias("psi"))


def ks_two_sample(long: DataFrame, side: str, by: list[str] | None = None) -> DataFrame:
    """Largest gap between the distribution functions of side 0 and side 1 of (feature, value), with an asymptotic p-value.
    Rows are first merged into counts of distinct values."""
    keys = [*(by or []), "feature"]
    h = long.where(finite("value")).groupBy(*keys, "value").agg(F.count_if(F.col(side) == 0).alias("a"), F.count_if(F.col(side) == 1).alias("b"))
    gaps = running_by_value(h, keys, "value", ["a", "b"]).withColumn("gap", F.abs(F.col("run_a") / F.col("all_a") - F.col("run_b") / F.col("all_b")))
    out = gaps.groupBy(*keys).agg(F.coalesce(F.max("gap"), F.lit(0.0)).alias("ks"), F.max("all_a").alias("n_a"), F.max("all_b").alias("n_b"))
    size = F.sqrt(F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b")))
    lam = F.col("ks") * (size + 0.12 + 0.11 / size)
    series = sum((F.lit(2.0 * (-1) ** (k - 1)) * F.exp(-2.0 * k * k * lam * lam) for k in range(1, 41)), F.lit(0.0))
    return out.withColumn("p_value", F.when(lam < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series))))


def drift_ranking(reference: DataFrame, target: DataFrame) -> DataFrame:
    """KS, PSI and means of every feature, ranked by KS, then name."""
    both = reference.withColumn("side", F.lit(0)).unionByName(target.withColumn("side", F.lit(1)))
    means = both.where(finite("value")).groupBy("feature").agg(F.avg(F.when(F.col("side") == 0, F.col("value"))).alias("mean_reference"), F.avg(F.when(F.col("side") == 1, F.col("value"))).alias("mean_target"))
    out = ks_two_sample(both, "side").select("feature", "ks").join(psi(reference, target), "feature").join(means, "feature")
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("ks", 9)), "feature")))


def step_medians(long: DataFrame, step: str = "step") -> DataFrame:
    return quantiles(long.where(finite("value")), ["feature", step], "value", [0.5], "q").select("feature", step, F.get("q", F.lit(0)).alias("median"))


def monotone_detect(medians: DataFrame, cut: float = 0.99, least_steps: int = 10, step: str = "step") -> DataFrame:
    """Whether a feature's step medians follow the step: Spearman at or above the cut over enough steps, not constant."""
    rho = spearman(medians.withColumn("_m", F.round("median", 9)), "_m", step, ["feature"])
    size = medians.groupBy("feature").agg(F.count("*").alias("steps"), F.countDistinct("median").alias("distinct_medians"))
    return rho.join(size, "feature").withColumn("monotone", F.coalesce((F.abs("rho") >= cut) & (F.col("steps") >= least_steps) & (F.col("distinct_medians") > 1), F.lit(False)))


def detrend_fit(medians: DataFrame, step: str = "step") -> DataFrame:
    """A linear and, if all medians are positive, an exponential trend of step medians; the one of lower RMSE."""
    fits = medians.groupBy("feature").agg(
        F.expr(f"regr_slope(median, {step})").alias("slope"), F.expr(f"regr_intercept(median, {step})").alias("intercept"),
        F.expr(f"regr_slope(CASE WHEN median > 0 THEN ln(median) END, {step})").alias("log_slope"), F.expr(f"regr_intercept(CASE WHEN median > 0 THEN ln(median) END, {step})").alias("log_intercept"),
        F.bool_and(F.col("median") > 0).alias("positive"),
    )
    errors = medians.join(fits, "feature")
    linear = F.sqrt(F.avg(F.pow(F.col("median") - F.col("intercept") - F.col("slope") * F.col(step), 2)))
    log = F.sqrt(F.avg(F.pow(F.col("median") - F.exp(F.col("log_intercept") + F.col("log_slope") * F.col(step)), 2)))
    rmse = errors.groupBy("feature").agg(linear.alias("linear_rmse"), log.alias("log_rmse"))
    return fits.join(rmse, "feature").withColumn("kind", F.when(F.col("positive") & (F.col("log_rmse") < F.col("linear_rmse")), "log").otherwise("linear"))


def detrend_apply(long: DataFrame, fit: DataFrame, step: str = "step") -> DataFrame:
    """Values less the trend at their step; ``fit`` has one row a feature."""
    trend = F.when(F.col("kind") == "log", F.exp(F.col("log_intercept") + F.col("log_slope") * F.col(step))).otherwise(F.col("intercept") + F.col("slope") * F.col(step))
    keep = F.broadcast(fit.select("feature", "kind", "slope", "intercept", "log_slope", "log_intercept"))
    return long.join(keep, "feature").withColumn("value", F.col("value") - trend).select(*long.columns)


def drift_cells(long: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, feature, bin, n, mean, variance): finite values counted in the bins between the inner edges of their feature, whose
    moments come along. One pass; ``edges`` has one row a feature."""
    inner = F.when(F.size("edges") > 2, F.slice("edges", 2, F.size("edges") - 2)).otherwise(F.slice("edges", 1, 0))
    own = long.where(finite("value")).join(F.broadcast(edges.select("feature", inner.alias("inner"))), "feature")
    return own.groupBy(*by, "feature", bin_number("value", F.col("inner")).alias("bin")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("variance"))


def _pooled(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Mean m and population deviation s of each key from its cells."""
    w = Window.partitionBy(*keys)
    m = F.sum(F.col("n") * F.col("mean")).over(w) / F.sum("n").over(w)
    spread = cells.withColumn("_m", m)
    return spread.groupBy(*keys).agg(F.first("_m").alias("m"), F.sqrt(F.sum(F.expr("n * (variance + (mean - _m) * (mean - _m))")) / F.sum("n")).alias("s"))


def drift_score(reference: DataFrame, target: DataFrame, detrended: list[str], step: str = "step", bins: int = 10, floor: float = 1e-4, edges: DataFrame | None = None) -> DataFrame:
    """(step, feature, score, level): shift of the mean in reference deviations for features in ``detrended``, PSI for the
    others. Detrended features are judged by their shift, never by their PSI. Rows are read once for the edges and once for
    counts of bins, and all else starts from these."""
    edges = edges if edges is not None else small(reference_edges(reference, bins), "edges")
    both = reference.select("feature", "value", F.lit(None).cast("int").alias(step)).unionByName(target.select("feature", "value", step))
    return drift_score_of(small(drift_cells(both, edges, [step]), "cells"), edges, detrended, floor, step)


def drift_score_of(cells: DataFrame, edges: DataFrame, detrended: list[str], floor: float = 1e-4, step: str = "step") -> DataFrame:
    """The same from cells of both sides; those of the reference have a null step."""
    r, t = cells.where(F.col(step).isNull()), cells.where(F.col(step).isNotNull())
    base = _pooled(r, ["feature"])
    now = t.groupBy(step, "feature").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mt"), F.min("mean").alias("least"), F.max("mean").alias("most"))
    q = r.select("feature", "bin", (F.col("n") / F.sum("n").over(Window.partitionBy("feature"))).alias("q"))
    p = t.select(step, "feature", "bin", (F.col("n") / F.sum("n").over(Window.partitionBy(step, "feature"))).alias("p"))
    grid = now.select(step, "feature").join(edges, "feature").select(step, "feature", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("edges") - 2))).alias("bin"))
    full = grid.join(q, ["feature", "bin"], "left").join(p, [step, "feature", "bin"], "left")
    w = Window.partitionBy(step, "feature")
    for c in ("p", "q"):
        full = full.withColumn(c, F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(floor)))
        full = full.withColumn(c, F.col(c) / F.sum(c).over(w))
    psi = full.groupBy(step, "feature").agg(F.when(F.count("*") == 1, 0.0).otherwise(F.sum((F.col("p") - F.col("q")) * F.ln(F.col("p") / F.col("q")))).alias("psi"))
    joined = now.join(base, "feature").join(psi, [step, "feature"])
    shift = F.when(F.col("s") > 0, F.abs(F.col("mt") - F.col("m")) / F.col("s")).otherwise(F.when(F.col("mt") == F.col("m"), 0.0).otherwise(F.lit(float("inf"))))
    constants = (F.col("s") == 0) & (F.col("least") == F.col("most")) & (F.col("mt") != F.col("m"))
    score = F.when(F.col("feature").isin(detrended), shift).otherwise(F.when(constants, F.lit(float("inf"))).otherwise(F.col("psi")))
    return joined.select(step, "feature", score.alias("drift_score"), drift_level(score).alias("level"), F.when(constants, F.lit(float("inf"))).otherwise(F.col("psi")).alias("psi"))


def two_tier_report(scores: DataFrame, triad: list[str], step: str = "step") -> DataFrame:
    """Per step the worst level of the focal features, shares of the others above each bound, and the overall level."""
    focal = F.col("feature").isin(triad)
    rank = F.when(F.col("level") == "SIGNIFICANT", 2).when(F.col("level") == "MODERATE", 1).otherwise(0)
    out = scores.groupBy(step).agg(
        F.max(F.when(focal, rank)).alias("f"), F.max(F.when(focal, F.col("drift_score"))).alias("focal_max"),
        (100.0 * F.count_if(~focal & (rank >= 1)) / F.count_if(~focal)).alias("moderate_percent"), (100.0 * F.count_if(~focal & (rank == 2)) / F.count_if(~focal)).alias("significant_percent"),
    )
    name = lambda c: F.when(c == 2, "SIGNIFICANT").when(c == 1, "MODERATE").otherwise("STABLE")
    overall = F.when((F.col("f") == 2) | (F.col("significant_percent") >= 20), 2).when((F.col("f") == 1) | (F.col("moderate_percent") >= 20), 1).otherwise(0)
    return out.select(step, name(F.col("f")).alias("focal_level"), "focal_max", "moderate_percent", "significant_percent", name(overall).alias("overall_level"))


def reference_methods(long: DataFrame, train_last: int, first: int, last: int, step: str = "step", width: int = 10) -> DataFrame:
    """Four ways to choose a reference for each later step of a feature: the change of its step mean in deviations of past
    changes, PSI against the trailing steps, shift of the detrended mean, and distance of quantile shapes."""
    own = long.where(finite("value"))
    by = own.groupBy("feature", step).agg(F.avg("value").alias("m")).join(quantiles(own, ["feature", step], "value", [0.1, 0.25, 0.5, 0.75, 0.9], "q"), ["feature", step])
    w = Window.partitionBy("feature").orderBy(step)
    delta = by.withColumn("d", F.col("m") - F.lag("m").over(w))
    past = delta.where(F.col(step) <= train_last).groupBy("feature").agg(F.avg("d").alias("dm"), F.stddev_pop("d").alias("ds"))
    one = delta.where(F.col(step) >= first).join(past, "feature").select("feature", step, F.abs((F.col("d") - F.col("dm")) / F.col("ds")).alias("delta_z"))
    medians = step_medians(long.where(F.col(step) <= train_last), step)
    flat = detrend_apply(long, detrend_fit(medians, step), step)
    base = flat.where(F.col(step) <= train_last).groupBy("feature").agg(F.avg("value").alias("bm"), F.stddev_pop("value").alias("bs"))
    three = flat.where(F.col(step) >= first).groupBy("feature", step).agg(F.avg("value").alias("fm")).join(base, "feature").select("feature", step, F.abs((F.col("fm") - F.col("bm")) / F.col("bs")).alias("detrended_shift"))
    shape = F.transform("q", lambda x: (x - F.get("q", F.lit(2))) / (F.get("q", F.lit(3)) - F.get("q", F.lit(1))))
    shapes = by.withColumn("shape", shape)
    train = shapes.where(F.col(step) <= train_last).groupBy("feature").agg(F.array(*[F.avg(F.get("shape", F.lit(i))) for i in range(5)]).alias("train_shape"))
    distance = F.aggregate(F.zip_with("shape", "train_shape", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / 5
    four = shapes.where(F.col(step) >= first).join(train, "feature").select("feature", step, distance.alias("shape_distance"))
    two = trailing_psi(long.where(finite("value")), first, last, width, step=step).withColumnRenamed("psi", "trailing_psi")
    return one.join(two, ["feature", step]).join(three, ["feature", step]).join(four, ["feature", step])


def trailing_psi(long: DataFrame, first: int, last: int, width: int = 10, floor: float = 1e-4, step: str = "step") -> DataFrame:
    """(feature, step, psi): PSI of each later step against its previous ``width`` steps pooled, over the bins of all steps
    before ``first``."""
    edges = small(reference_edges(long.where(F.col(step) < first)), "edges")
    cells = small(drift_cells(long.where(F.col(step).between(first - width, last)), edges, [step]), "cells")
    grid = edges.select("feature", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("edges") - 2))).alias("bin"))
    own = cells.select("feature", "bin", "n", F.col(step).alias("_s"), F.explode(F.sequence(F.col(step), F.col(step) + width)).alias("t")).where(F.col("t").between(first, last))
    sums = own.groupBy("feature", "t", "bin").agg(F.sum(F.when(F.col("_s") == F.col("t"), F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("_s") < F.col("t"), F.col("n")).otherwise(0)).alias("q"))
    both = sums.groupBy("feature", "t").agg(F.sum("p").alias("np"), F.sum("q").alias("nq")).where("np > 0 and nq > 0")
    full = both.join(grid, "feature").join(sums, ["feature", "t", "bin"], "left").fillna(0, ["p", "q"])  # features x steps x bins
    w = Window.partitionBy("feature", "t")
    for c in ("p", "q"):
        full = full.withColumn(c, F.greatest(F.col(c) / F.col(f"n{c}"), F.lit(floor)))
        full = full.withColumn(c, F.col(c) / F.sum(c).over(w))
    return full.groupBy("feature", F.col("t").alias(step)).agg(F.sum((F.col("p") - F.col("q")) * F.ln(F.col("p") / F.col("q"))).alias("psi"))


def feature_shift_l2(reference: DataFrame, target: DataFrame, step: str = "step") -> DataFrame:
    """Root mean square over features of the shift of the step mean in reference deviations."""
    base = reference.where(finite("value")).groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    now = target.where(finite("value")).groupBy(step, "feature").agg(F.avg("value").alias("mt")).join(base, "feature").where("s > 0")
    return now.groupBy(step).agg((F.sqrt(F.sum(F.pow((F.col("mt") - F.col("m")) / F.col("s"), 2))) / F.sqrt(F.count("*"))).alias("shift_l2"))


def score_bin(edges: list[float], score: str = "score") -> Column:
    """How many of fixed edges are no greater."""
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= F.col(score)))


def score_bins(df: DataFrame, edges: list[float], score: str = "score", step: str = "step") -> DataFrame:
    """Share of each step's scores in fixed half-open bins."""
    counts = df.where(finite(score)).groupBy(step, score_bin(edges, score).alias("bin")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(step)))


def share_concentration(df: DataFrame, value: str, key: str) -> DataFrame:
    """Gini coefficient and the shares of the first 1, 3, 5 and 10 of a short table."""
    w = Window.orderBy(F.desc(value), key)
    r = df.withColumn("_r", F.row_number().over(w)).withColumn("_up", F.row_number().over(Window.orderBy(value, key)))
    total, n = F.sum(value), F.count("*")
    gini = 2 * F.sum(F.col("_up") * F.col(value)) / (n * total) - (n + 1) / n
    return r.agg(gini.alias("gini"), *[(F.sum(F.when(F.col("_r") <= k, F.col(value)).otherwise(0)) / total).alias(f"top{k}") for k in (1, 3, 5, 10)])


def importance_compare(a: DataFrame, b: DataFrame, key: str = "feature", value: str = "importance") -> DataFrame:
    """Two importance tables side by side: ranks, ratio, quadrant by medians, and how far the ranks disagree."""
    x = a.select(key, F.col(value).alias("a"))
    y = b.select(key, F.col(value).alias("b"))
    j = x.join(y, key, "full").fillna(0, ["a", "b"])
    whole = Window.partitionBy()
    j = j.withColumn("rank_a", F.row_number().over(Window.orderBy(F.desc("a"), key))).withColumn("rank_b", F.row_number().over(Window.orderBy(F.desc("b"), key)))
    j = j.withColumn("ratio", F.when(F.col("b") > 0, F.col("a") / F.col("b"))).withColumn("_ma", F.expr("percentile(a, 0.5)").over(whole)).withColumn("_mb", F.expr("percentile(b, 0.5)").over(whole))
    quadrant = F.concat(F.when(F.expr("a >= _ma"), "high").otherwise("low"), F.lit("/"), F.when(F.expr("b >= _mb"), "high").otherwise("low"))
    gap = F.abs(F.col("rank_a") - F.col("rank_b"))
    return j.withColumn("quadrant", quadrant).withColumn("agreement", F.when(gap <= 1, "agree").when(gap <= 3, "close").otherwise("differ")).drop("_ma", "_mb")


def kendall(df: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """Kendall's tau-b of a short table of at most some hundred rows, such as features or steps."""
    x = df.select(F.col(key).alias("k1"), F.col(a).alias("a1"), F.col(b).alias("b1"))
    y = df.select(F.col(key).alias("k2"), F.col(a).alias("a2"), F.col(b).alias("b2"))
    s = x.join(F.broadcast(y), F.expr("k1 < k2")).select(F.signum(F.expr("a1 - a2")).alias("s"), F.signum(F.expr("b1 - b2")).alias("t"))
    return s.agg((F.sum(F.expr("s * t")) / F.sqrt(F.sum(F.abs("s")) * F.sum(F.abs("t")))).alias("tau"))


def drift_verdict(metrics: DataFrame) -> DataFrame:
    """covariate, concept or none from (domain_auc, median_ks, in_window_ap, transferred_ap)."""
    material = (F.col("domain_auc") >= 0.80) | (F.col("median_ks") >= 0.30)
    concept = (F.col("in_window_ap") >= 5 * F.col("transferred_ap")) & ~material
    return metrics.withColumn("verdict", F.when(material, "covariate").when(concept, "concept").otherwise("none"))
