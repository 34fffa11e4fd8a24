"""Tables in the shared folder, and what the entry module does where parts are absent."""

import os
import shutil
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from steplens.operators.components import connected_components
from steplens.sources import scratch

ROOT = Path(__file__).resolve().parents[1]


def test_a_cluster_needs_a_shared_folder():
    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_dir(bare)


def test_released_tables_are_gone(spark):
    folder = scratch.shared_dir(spark)
    begun = scratch.mark(spark)
    kept = scratch.materialise(spark.range(3), "kept")
    middle = scratch.mark(spark)
    scratch.materialise(spark.range(4), "dropped")
    assert scratch.release(spark, middle) == 1 and scratch.release(spark, middle) == 0
    assert kept.count() == 3 and not [f for f in os.listdir(folder) if f.startswith("steplens-dropped-")]
    assert scratch.release(spark, begun) == 1


def test_components_leave_few_tables(spark):
    begun = scratch.mark(spark)
    found = connected_components(spark.range(60).selectExpr("id AS a", "id + 1 AS b"), "a", "b")
    assert {r["component"] for r in found.collect()} == {0}
    assert scratch.release(spark, begun) <= 8


def test_short_tables_need_no_exchange(spark):
    short = scratch.small(spark.range(5).selectExpr("id AS step", "id * 2 AS n"))
    plan = short.groupBy("step").sum("n").join(short, "step")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


@pytest.mark.parametrize("gone", [[], ["llm"], ["llm", "corpus_pipeline.py"]])
def test_the_rest_imports_without_the_subpackage(tmp_path, gone):
    for name in ("steplens", "__spark_entry__.py", "corpus_pipeline.py"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif source.exists():
            shutil.copy(source, tmp_path / name)
    if not (tmp_path / "steplens" / "llm").exists():
        pytest.skip("the subpackage is absent")
    if "llm" in gone:
        shutil.rmtree(tmp_path / "steplens" / "llm")
    if "corpus_pipeline.py" in gone:
        (tmp_path / "corpus_pipeline.py").unlink()
    code = "import __spark_entry__ as e; n = e.queries(); print(len([k for k in n if k.startswith('op') and k[2].isdigit()]), 'pipeline' in n, 'monitoring_table' in n)"
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout.split()
    assert said[-3:] == (["0", "False", "True"] if gone else ["13", "True", "True"])


def test_an_application_leaves_nothing_behind(tmp_path):
    """What queries write in the shared folder goes with the driver, though nothing releases it."""
    code = f"""
import os
from pyspark.sql import SparkSession
from steplens.sources import scratch
spark = SparkSession.builder.master("local[1]").config("spark.checkpoint.dir", {str(tmp_path)!r}).config("spark.ui.enabled", "false").getOrCreate()
scratch.materialise(spark.range(3), "left")
spark.range(3).write.parquet(scratch.folder(spark, "stream") + "/out")
assert sum(n.startswith("steplens-") for n in os.listdir({str(tmp_path)!r})) == 2
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=os.environ | {"PYTHONPATH": str(ROOT)}, check=True, capture_output=True, timeout=240)
    assert not [n for n in os.listdir(tmp_path) if n.startswith("steplens-")]  # Spark makes a folder of its own there
