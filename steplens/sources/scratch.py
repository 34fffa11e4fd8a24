"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What this process has written and not yet deleted, by application; deleted places are None.
_written: dict[str, list[str | None]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset it is set to a temporary one on this machine, deleted at
    the end of the process; a cluster needs a folder that all its machines share, so there it fails."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="steplens-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared


def owned(spark: SparkSession, path: str) -> str:
    """``path``, which the driver deletes when its application ends, wherever it lies: what single queries write has no other owner."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/steplens-{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)
    return owned(spark, path)


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return the written table: its lineage ends there, and it
    survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/steplens-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    owned(spark, path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark(spark: SparkSession) -> int:
    """A place in the order of what has been written, for ``release``."""
    return len(_written.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, since: int = 0, until: int | None = None) -> int:
    """Delete tables written from one mark to another, or to now, and return their number. Nothing that is still to be read
    may come from them."""
    own, gone = _written.get(spark.sparkContext.applicationId, []), 0
    for i in range(since, len(own) if until is None else until):
        if own[i] is not None:
            path = spark._jvm.org.apache.hadoop.fs.Path(own[i])
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            own[i], gone = None, gone + 1
    return gone


def settle(spark: SparkSession) -> None:
    """Let go of plans that nothing refers to any more, in Python and in the JVM: Spark deletes the shuffle files of a plan when
    its references are collected, which it would else wait for while they fill disks."""
    gc.collect()
    spark._jvm.System.gc()


#: Rows of a short table that the driver may hold.
MOST_SMALL = 100_000


def small(df: DataFrame, name: str = "small") -> DataFrame:
    """A short table, such as one of steps or features, worked out once and held in one partition, so that windows and
    aggregates over it, and joins of such tables, need no exchange. Up to ``MOST_SMALL`` rows stay with the driver; a longer
    one is written like any other."""
    rows = df.limit(MOST_SMALL + 1).toArrow()
    if rows.num_rows > MOST_SMALL:
        return materialise(df, name)
    return df.sparkSession.createDataFrame(rows, schema=df.schema).coalesce(1)


#: Rows of a table that one task sorts, where rows shrink so much as they travel that their bytes say little.
PART_ROWS = 1 << 19


def parts_for(rows: int) -> int:
    """Into how many tasks ``rows`` are dealt."""
    return max(8, -(-rows // PART_ROWS))
