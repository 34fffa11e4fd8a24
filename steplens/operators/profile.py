"""Distributions, per-step counts, column profiles, correlation and separation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steplens.operators.gram import correlations
from steplens.operators.prefix import positions, quantiles
from steplens.operators.ranking import auc_of
from steplens.operators.rows import finite


def unpivot(df: DataFrame, keep: list[str], columns: list[str]) -> DataFrame:
    """(keep, feature, value) in double precision."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])).alias("c")
    return df.select(*keep, cells).select(*keep, "c.feature", "c.value")


def class_distribution(df: DataFrame, cls: str = "cls") -> DataFrame:
    """Rows, share of all, and negative rows for each positive one."""
    one = df.agg(F.count("*").alias("total"), F.count_if(F.col(cls) == 1).alias("p"), F.count_if(F.col(cls) == 2).alias("q"), F.count_if(F.col(cls) == 3).alias("u"))
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("cls"), F.col(c).alias("n")) for i, c in ((1, "p"), (2, "q"), (3, "u"))])).alias("r")
    ratio = F.when(F.col("p") > 0, F.col("q") / F.col("p"))
    return one.select(rows, "total", ratio.alias("negatives_per_positive")).select("r.cls", "r.n", (100.0 * F.col("r.n") / F.col("total")).alias("percent"), "negatives_per_positive")


def step_label_counts(df: DataFrame, spine: DataFrame, step: str = "step", y: str = "y") -> DataFrame:
    """Total, labelled, positive, negative and unknown rows of every step of the spine, 0 where there are none."""
    counts = df.groupBy(step).agg(F.count("*").alias("total"), F.count(y).alias("labelled"), F.count_if(F.col(y) == 1).alias("positive"), F.count_if(F.col(y) == 0).alias("negative"), F.count_if(F.col(y).isNull()).alias("unknown"))
    return spine.join(counts, step, "left").fillna(0)


def temporal_summary(counts: DataFrame, columns: list[str]) -> DataFrame:
    """Least, median and greatest of each column of a per-step table."""
    stats = F.array(*[F.struct(F.lit(c).alias("column"), F.min(c).alias("least"), F.expr(f"percentile({c}, 0.5)").alias("median"), F.max(c).alias("greatest")) for c in columns])
    return counts.agg(stats.alias("s")).select(F.explode("s").alias("s")).select("s.*")


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, missing, infinite, mean, population deviation, range, zero and negative shares, constancy: one wide pass."""
    stats = []
    for c in columns:
        ok = finite(c)
        v = F.when(ok, F.col(c).cast("double"))
        count = F.count(v)
        top = F.max(v) - F.min(v)
        stats.append(F.struct(
            F.lit(c).alias("column"), count.alias("n"), F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias("missing"), F.count_if(F.abs(F.col(c).cast("double")) == float("inf")).alias("infinite"),
            F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("least"), F.max(v).alias("greatest"),
            (100.0 * F.count_if(v == 0) / count).alias("zero_percent"), (100.0 * F.count_if(v < 0) / count).alias("negative_percent"), (top == 0).alias("constant"), (F.stddev_pop(v) < 1e-6).alias("near_constant"),
        ))
    return df.agg(F.array(*stats).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def label_moments(df: DataFrame, columns: list[str], y: str = "y") -> DataFrame:
    """n, sum and sum of squares of each column for each label."""
    long = unpivot(df.where(F.col(y).isNotNull()), [y], columns).where(finite("value"))
    return long.groupBy("feature", y).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.sum(F.col("value") * F.col("value")).alias("squares"))


def point_biserial(df: DataFrame, columns: list[str], y: str = "y") -> DataFrame:
    """Correlation of each column with the label over labelled rows."""
    known = df.where(F.col(y).isNotNull())
    stats = F.array(*[F.struct(F.lit(c).alias("feature"), F.corr(F.col(c).cast("double"), F.col(y).cast("double")).alias("r")) for c in columns])
    return known.agg(stats.alias("s")).select(F.explode("s").alias("s")).select("s.*")


def early_late_shift(df: DataFrame, columns: list[str], last_early: int = 34, step: str = "step") -> DataFrame:
    """Mean up to a step, mean after it, and their difference in population deviations."""
    stats = []
    for c in columns:
        a, b = F.avg(F.when(F.col(step) <= last_early, F.col(c))), F.avg(F.when(F.col(step) > last_early, F.col(c)))
        stats.append(F.struct(F.lit(c).alias("feature"), a.alias("early"), b.alias("late"), F.when(F.stddev_pop(c) > 0, (b - a) / F.stddev_pop(c)).alias("shift")))
    return df.agg(F.array(*stats).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def systematic_sample(df: DataFrame, key: str, stride: int) -> DataFrame:
    """Every ``stride``-th row in the order of a unique key. A row's rank is its place in its range of the order plus the rows of the
    ranges before it, so no task sees the whole order."""
    return positions(df, [], [F.col(key)], "_place", "_size", "sample").where(F.col("_place") % stride == 0).select(*df.columns)


def sample_quantiles(df: DataFrame, columns: list[str]) -> DataFrame:
    """p1, p25, p50, p75, p99 by linear interpolation, and the sample-adjusted skew, of finite values."""
    long = unpivot(df, [], columns).where(finite("value"))
    n = F.count(F.lit(1))
    skew = long.groupBy("feature").agg(F.when(n > 2, F.skewness("value") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"))
    q = quantiles(long, ["feature"], "value", [0.01, 0.25, 0.5, 0.75, 0.99], "q")
    return q.join(skew, "feature").select("feature", *[F.get("q", F.lit(i)).alias(a) for i, a in enumerate(("p1", "p25", "p50", "p75", "p99"))], "skew")


def corr_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, i, j, r) for every two columns, a before b in the list: matrix products of batches, added up."""
    return correlations(df, columns)


def redundant_pairs(matrix: DataFrame, cut: float) -> DataFrame:
    """Pairs at or above a correlation; the second of each is the one to drop."""
    return matrix.where(F.abs("r") >= cut).select("a", "b", "r", F.col("b").alias("drop"))


def best_match_column(matrix: DataFrame, targets: list[str]) -> DataFrame:
    """For each target the other column of the largest absolute correlation, ties to the first name."""
    both = matrix.select(F.col("a").alias("target"), F.col("b").alias("other"), "r").unionByName(matrix.select(F.col("b").alias("target"), F.col("a").alias("other"), "r"))
    own = both.where(F.col("target").isin(targets) & ~F.col("other").isin(targets))
    w = Window.partitionBy("target").orderBy(F.desc(F.round(F.abs("r"), 9)), "other")
    return own.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("target", "other", "r")


def collinear_partners(matrix: DataFrame, focal: list[str], strong: float, some: float, top: int = 3) -> DataFrame:
    """Partners of focal columns with their tier, the first ``top`` by absolute correlation."""
    both = matrix.select(F.col("a").alias("focal"), F.col("b").alias("partner"), "r").unionByName(matrix.select(F.col("b").alias("focal"), F.col("a").alias("partner"), "r")).where(F.col("focal").isin(focal))
    tier = F.when(F.abs("r") >= strong, "strong").when(F.abs("r") >= some, "some").otherwise("weak")
    w = Window.partitionBy("focal").orderBy(F.desc(F.round(F.abs("r"), 9)), "partner")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("focal", "partner", "r", tier.alias("tier"), "rank")


def single_feature_auc(df: DataFrame, columns: list[str], y: str = "y") -> DataFrame:
    """AUC of each column against the label, and its distance from a half."""
    long = unpivot(df.where(F.col(y).isNotNull()), [y], columns).where(finite("value"))
    h = long.groupBy("feature", F.col("value").alias("score")).agg(F.count("*").alias("n"), F.sum(y).cast("long").alias("pos"))
    return auc_of(h, ["feature"]).withColumn("strength", F.abs(F.col("auc") - 0.5))


def average_rank(value: str, partition: list[str], total: str | None = None) -> Column:
    """Rank from the least up, ties averaged."""
    w = Window.partitionBy(*partition).orderBy(value)
    ties = Window.partitionBy(*partition, value)
    return F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2


def spearman(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Correlation of average ranks within each group; for short tables such as per-step ones."""
    ranked = df.withColumn("_a", average_rank(a, by)).withColumn("_b", average_rank(b, by))
    return ranked.groupBy(*by).agg(F.corr("_a", "_b").alias("rho"))


def variance_signature(df: DataFrame, columns: list[str], step: str = "step") -> DataFrame:
    """Between-step and within-step variance of each feature, eta squared, Spearman of its step means with the step, and
    what that says."""
    by_step = unpivot(df, [step], columns).groupBy("feature", step).agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    rho = spearman(by_step.withColumn("_m", F.round("m", 9)), "_m", step, ["feature"])
    w = Window.partitionBy("feature")
    total = F.sum("n").over(w)
    grand = F.sum(F.col("n") * F.col("m")).over(w) / total
    parts = by_step.withColumn("inside", F.col("n") * F.col("v") / total).withColumn("between", F.col("n") * F.pow(F.col("m") - grand, 2) / total)
    out = parts.groupBy("feature").agg(F.sum("inside").alias("within_var"), F.sum("between").alias("between_var")).join(rho, "feature")
    eta = F.col("between_var") / (F.col("between_var") + F.col("within_var"))
    out = out.withColumn("eta2", F.when(F.col("between_var") + F.col("within_var") > 0, eta))
    return out.withColumn("verdict", F.when((F.abs("rho") >= 0.9) & (F.col("eta2") >= 0.5), "clock").when(F.col("eta2") >= 0.5, "regime").otherwise("stationary"))


def rank_table(df: DataFrame, metric: str, key: str, top: int) -> DataFrame:
    """The first rows by a metric, ties to the smaller key, with their rank."""
    first = df.orderBy(F.desc(metric), key).limit(top)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(metric), key)))
