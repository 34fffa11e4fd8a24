"""Training sets and models over steps: splits, weights, scaling, a logistic regression."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steplens.operators.prefix import quantiles
from steplens.operators.profile import unpivot
from steplens.operators.rows import batch_classify, finite, window_mask


def temporal_split(df: DataFrame, windows: DataFrame, parts: tuple[str, ...] = ("fit", "validation", "test"), step: str = "step") -> DataFrame:
    """Rows and labelled rows of each part, how many of its steps another part has too, and how many rows of the table are in
    no part at all: a sound split has none of either."""
    tagged = window_mask(df, windows.where(F.col("window").isin(*parts)), step)
    per_step = tagged.groupBy(step, "window").agg(F.count("*").alias("n"), F.count("y").alias("labelled"))
    twice = F.count("*").over(Window.partitionBy(step)) > 1
    out = per_step.withColumn("_twice", twice).groupBy("window").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.count_if("_twice").alias("shared_steps"))
    steps = windows.where(F.col("window").isin(*parts)).select(F.explode(F.sequence("lo", "hi")).alias(step)).distinct()
    outside = df.groupBy(step).agg(F.count("*").alias("m")).join(steps, step, "left_anti").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("uncovered"))
    return out.crossJoin(F.broadcast(outside))  # one row


def policy_window(policies: DataFrame, steps: DataFrame, step: str = "step") -> DataFrame:
    """First and last training step of each policy (policy, kind, width, lag) for a decision at t: labels up to t - lag. Kinds:
    static, rolling, recency (weighted by age), ablation (without the focal features), and anything else expanding."""
    newest = F.col("t") - F.col("lag")
    first = F.when(F.col("kind") == "rolling", F.greatest(F.lit(1), newest - F.col("width") + 1)).otherwise(1)
    last = F.when(F.col("kind") == "static", F.least(newest, F.col("width"))).otherwise(newest)
    pairs = steps.select(F.col(step).alias("t")).crossJoin(F.broadcast(policies))  # steps x policies
    return pairs.select("policy", "lag", "t", first.cast("int").alias("first"), last.cast("int").alias("last"), (F.col("kind") == "recency").alias("weighted"), (F.col("kind") == "ablation").alias("ablated"))


def choose_holdout(counts: DataFrame, decisions: DataFrame, lag: int = 1, least: int = 40, low: int = 2, high: int = 6, step: str = "step", pos: str = "positive") -> DataFrame:
    """The least number of newest arrived steps, from ``low`` to ``high``, with enough positives; ``high`` if none has."""
    d = decisions.select(F.col(step).alias("t"))
    w = Window.partitionBy("t").orderBy(F.desc(step)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    past = d.join(F.broadcast(counts.select(step, pos)), F.col(step) <= F.col("t") - lag)
    run = past.withColumn("k", F.row_number().over(Window.partitionBy("t").orderBy(F.desc(step)))).withColumn("held", F.sum(pos).over(w)).where(F.col("k").between(low, high))
    return run.groupBy("t").agg(F.coalesce(F.min(F.when(F.col("held") >= least, F.col("k"))), F.lit(high)).alias("holdout"))


def recency_weight(steps: DataFrame, newest: int, half_life: float, step: str = "step", kind: str = "exponential") -> DataFrame:
    """0.5 ** (age / half-life), or, linear, a share that falls by one in twice the half-life and never under a tenth; over
    the mean of that. ``steps`` has one row a step."""
    age = F.lit(newest) - F.col(step)
    w = F.pow(F.lit(0.5), age / F.lit(half_life)) if kind == "exponential" else F.greatest(F.lit(0.1), 1 - age / F.lit(2 * half_life))
    return steps.where(F.col(step) <= newest).withColumn("_w", w).withColumn("weight", F.col("_w") / F.avg("_w").over(Window.partitionBy())).drop("_w")


def class_weight(df: DataFrame, by: list[str] | None = None, y: str = "y") -> DataFrame:
    """Negative rows for each positive one, over labelled rows."""
    return df.where(F.col(y).isNotNull()).groupBy(*(by or [])).agg(F.count_if(F.col(y) == 1).alias("positive"), F.count_if(F.col(y) == 0).alias("negative"), F.when(F.count_if(F.col(y) == 1) > 0, F.count_if(F.col(y) == 0) / F.count_if(F.col(y) == 1)).alias("weight"))


def standardise(df: DataFrame, columns: list[str], fitted: Column) -> DataFrame:
    """Columns less the mean over the population deviation of the rows where ``fitted`` holds; a constant one becomes 0."""
    own = df.where(fitted).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    scaled = {c: F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0) for c in columns}
    return df.crossJoin(F.broadcast(own)).withColumns(scaled).select(*df.columns)  # one row


def impute_median(df: DataFrame, columns: list[str], fitted: Column) -> DataFrame:
    """Missing and non-finite cells as the exact median of the rows where ``fitted`` holds."""
    medians = quantiles(unpivot(df.where(fitted), [], columns).where(finite("value")), ["feature"], "value", [0.5], "q")
    own = medians.agg(*[F.max(F.when(F.col("feature") == c, F.get("q", F.lit(0)))).alias(f"_p_{c}") for c in columns])
    return df.crossJoin(F.broadcast(own)).withColumns({c: F.when(finite(c), F.col(c)).otherwise(F.col(f"_p_{c}")) for c in columns}).select(*df.columns)  # one row


def linear_model(train: DataFrame, features: list[str], y: str = "y", balanced: bool = True, weight: str | None = None, reg: float = 0.01) -> PipelineModel:
    """Scaled logistic regression; ``balanced`` gives each class half of the weight."""
    known = train.where(F.col(y).isNotNull()).select(*features, F.col(y).cast("double").alias("label"), (F.col(weight) if weight else F.lit(1.0)).alias("_w"))
    if balanced:
        n, p = known.agg(F.count("*"), F.sum("label")).first()
        if not n or not 0 < p < n:
            raise ValueError("a model needs labelled rows of both classes")
        known = known.withColumn("_w", F.col("_w") * F.when(F.col("label") == 1, n / (2 * p)).otherwise(n / (2 * (n - p))))
    stages = [VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="keep"), StandardScaler(inputCol="_raw", outputCol="features", withMean=True), LogisticRegression(weightCol="_w", regParam=reg, maxIter=30)]
    return Pipeline(stages=stages).fit(known)


def model_score(model: PipelineModel, df: DataFrame, out: str = "score") -> DataFrame:
    scored = model.transform(df.drop(out)).withColumn(out, vector_to_array("probability")[1])
    return scored.select(*[c for c in df.columns if c != out], out)


def batch_score(model: PipelineModel, df: DataFrame, tau: float = 0.435) -> DataFrame:
    return batch_classify(model_score(model, df), tau=tau)


