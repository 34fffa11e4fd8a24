"""Tables laid out by step: few files a step, and files of other steps are never opened."""

import glob

from pyspark.sql import functions as F

from steplens.sources.readers import scan_steps, sink_by_step


def scans(plan):
    """The file scans of a plan that has run."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return scans(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return scans(plan.plan())
    if name == "FileSourceScanExec":
        return [plan]
    below = plan.children()
    return [s for i in range(below.size()) for s in scans(below.apply(i))]


def test_only_the_wanted_folders_are_read(spark, tmp_path):
    path = str(tmp_path / "laid")
    rows = spark.range(20_000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 40).cast("int").alias("step"))
    sink_by_step(rows.repartition(8), path)
    files = glob.glob(f"{path}/*/*.parquet")
    assert len(files) < 40 * 3 and len(glob.glob(f"{path}/step=*")) == 40
    laid = spark.read.parquet(path)
    spark.createDataFrame([(s, s % 8) for s in range(60)], "step int, positive int").write.parquet(str(tmp_path / "spine"))
    wanted = spark.read.parquet(str(tmp_path / "spine")).where("positive > 6")
    found = scan_steps(laid, wanted)
    got = {r["step"]: r["count"] for r in found.groupBy("step").count().collect()}
    assert got == {r["step"]: r["count"] for r in rows.where("step % 8 = 7").groupBy("step").count().collect()}
    counted = found.agg(F.sum("id"))
    counted.collect()
    read = [s.metrics().apply("numFiles").value() for s in scans(counted._jdf.queryExecution().executedPlan()) if "laid" in s.toString()]
    assert read == [len([f for f in files if int(f.split("step=")[1].split("/")[0]) % 8 == 7])]
