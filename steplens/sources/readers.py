"""Typed and tolerant readers, and strict sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def scan_typed(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A CSV file with a header under a declared schema; a cell that does not fit its type is null."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def scan_malformed(spark: SparkSession, path: str, schema: str, header: bool = False) -> DataFrame:
    """The rows of a CSV file that do not have the width of its schema: what could be read, and the raw line."""
    full = f"{schema}, {CORRUPT} string"
    rows = spark.read.schema(full).option("header", header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False).csv(path)
    return rows.where(F.col(CORRUPT).isNotNull())


def scan_pruned(df: DataFrame, columns: list[str]) -> DataFrame:
    """Only the named columns; the scan reads no others."""
    return df.select(*columns)


def scan_filter(df: DataFrame, steps: tuple[int, int] | None = None, ids: DataFrame | None = None, key: str = "tx_id", step: str = "step") -> DataFrame:
    """Rows of a closed step range, and of the ids given."""
    if steps:
        df = df.where(F.col(step).between(*steps))
    return df.join(ids.select(key).distinct(), key, "left_semi") if ids is not None else df


def scan_decisions(spark: SparkSession, path: str) -> DataFrame:
    """One row for each decision of a nested JSON report (multi-line, an array under ``decisions``)."""
    report = spark.read.option("multiLine", True).json(path)
    return report.select(F.explode("decisions").alias("d")).select("d.*")


def finite_or_null(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def strict_json(df: DataFrame) -> DataFrame:
    """``df`` as it may be written to strict JSON: NaN and infinities are null."""
    kinds = (T.DoubleType, T.FloatType)
    return df.select(*[finite_or_null(f.name).alias(f.name) if isinstance(f.dataType, kinds) else F.col(f.name) for f in df.schema.fields])


def sink_strict_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    strict_json(df).write.mode(mode).option("ignoreNullFields", False).json(path)


def sink_tables(tables: dict[str, DataFrame], folder: str, form: str = "parquet", mode: str = "errorifexists") -> None:
    """One folder for each table."""
    for name, df in tables.items():
        df.write.mode(mode).format(form).option("header", True).save(f"{folder.rstrip('/')}/{name}")


def prediction_log(scored: DataFrame, version: str = "v1") -> DataFrame:
    """Scored rows in the shape of the prediction log; logged_at is the time of the query."""
    return scored.select(F.current_timestamp().alias("logged_at"), F.lit(version).alias("model_version"), "*")


def sink_prediction_log(scored: DataFrame, path: str, version: str = "v1") -> None:
    prediction_log(scored, version).write.mode("append").json(path)


def sink_by_step(df: DataFrame, path: str, step: str = "step", mode: str = "errorifexists") -> None:
    """A folder for each step. Rows are dealt by step first, so a step has few files; Spark splits a step that holds very many rows and
    joins small ones, so no task writes a hot step alone."""
    df.hint("rebalance", F.col(step)).write.mode(mode).partitionBy(step).parquet(path)


def scan_steps(laid: DataFrame, wanted: DataFrame, step: str = "step") -> DataFrame:
    """Rows of a table laid out by step whose step is among the ``wanted``, a table of steps that may itself be the outcome of a query: its
    steps prune the folders before any file is opened."""
    return laid.join(F.broadcast(wanted.select(step).distinct()), step, "left_semi")  # one row a step
