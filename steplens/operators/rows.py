"""Row rules: labels, windows, validation, classification, context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def feature_family(df: DataFrame, prefix: str) -> list[str]:
    """The columns of one family, in table order."""
    return [c for c in df.columns if c.startswith(prefix)]


def check_contract(df: DataFrame, names: list[str]) -> None:
    """The feature columns must be these names in this order."""
    found = [c for c in df.columns if c in set(names)]
    if found != names:
        raise ValueError(f"features differ from the contract in name or order: {found} against {names}")


def parse_step(cell: str | Column) -> Column:
    """The whole part of a numeric cell; null if it is no number."""
    c = F.col(cell) if isinstance(cell, str) else cell
    return c.try_cast("double").try_cast("int")


def label_map(cls: str = "cls") -> Column:
    """1 for the positive class, 0 for the negative one, null for the unknown one."""
    return F.when(F.col(cls) == 1, 1).when(F.col(cls) == 2, 0)


def window_mask(df: DataFrame, windows: DataFrame, step: str = "step") -> DataFrame:
    """``df`` once for each named window its step falls in; ``windows`` is a short table of constants."""
    w = F.broadcast(windows)
    return df.join(w, F.col(step).between(w["lo"], w["hi"]))


def finite(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def labelled(df: DataFrame, cls: str = "cls") -> DataFrame:
    """Rows of a known class. The unknown class is never a label."""
    return df.where(F.col(cls).isin(1, 2))


def has_addresses(tx: DataFrame, *edges: DataFrame, key: str = "tx_id") -> DataFrame:
    """``tx`` with 1 where it occurs in any of the edge lists, else 0."""
    linked = edges[0].select(key)
    for e in edges[1:]:
        linked = linked.unionByName(e.select(key))
    return tx.join(linked.distinct().withColumn("has_addresses", F.lit(1)), key, "left").fillna(0, ["has_addresses"])


def row_errors(features: list[str], known: list[str] | None = None) -> Column:
    """Codes of what is wrong with a row of string cells: missing, not numeric, not finite."""
    codes = []
    for f in features:
        c = F.col(f).cast("string")
        number = c.try_cast("double")
        code = F.when(c.isNull() | (F.trim(c) == ""), F.lit(f"missing:{f}")).when(number.isNull(), F.lit(f"non_numeric:{f}")).when(F.isnan(number) | (F.abs(number) == float("inf")), F.lit(f"not_finite:{f}"))
        codes.append(code)
    codes += [F.lit(f"unknown:{f}") for f in (known or []) if f not in features]
    return F.array_compact(F.array(*codes)) if codes else F.array().cast("array<string>")


def row_validate(df: DataFrame, features: list[str]) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows with their error codes)."""
    checked = df.withColumn("errors", row_errors(features))
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def batch_classify(df: DataFrame, score: str = "score", tau: float = 0.435) -> DataFrame:
    """Clamped score, decision and its name. NaN never reaches the threshold."""
    s = F.when(F.isnan(score), None).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score))))
    df = df.withColumn("probability", s)
    hit = F.coalesce(F.col("probability") >= tau, F.lit(False))
    return df.withColumn("predicted", hit.cast("int")).withColumn("decision", F.when(hit, "positive").otherwise("negative"))


def regime_context(df: DataFrame, regimes: DataFrame, by_step: DataFrame, step: str = "step") -> DataFrame:
    """``df`` with the regime of its step (regime, lo, hi, reliability) and the step's past metrics, where there are any."""
    r = F.broadcast(regimes)
    return df.join(r, F.col(step).between(r["lo"], r["hi"]), "left").drop("lo", "hi").join(by_step, step, "left")


def feature_fingerprint(columns: list[str], digits: int = 6) -> Column:
    """The first 16 hex digits of the SHA-256 of the rounded features."""
    parts = [F.coalesce(F.format_number(F.round(F.col(c).cast("double"), digits), digits), F.lit("null")) for c in columns]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def mask_id(c: str, keep: int = 3) -> Column:
    """The ends of an id, with dots between."""
    s = F.col(c).cast("string")
    return F.concat(F.substring(s, 1, keep), F.lit("..."), F.expr(f"right(cast({c} as string), 2)"))
