"""The step-indexed views over the driver tables, each once for Spark and once as oracle SQL."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steplens.sources.scratch import parts_for

#: Steps of the transaction views, and the label codes.
FIRST_STEP, LAST_STEP, DRIFT_STEP = 1, 49, 43
POSITIVE, NEGATIVE, UNKNOWN = 1, 2, 3
#: Named closed step ranges; they overlap.
WINDOWS = {"fit": (1, 24), "validation": (25, 34), "train": (1, 34), "test": (35, 49), "early": (35, 42), "drift": (43, 49)}
#: Fixed value: the decision threshold frozen on validation.
FROZEN_TAU = 0.435

_LABEL = "CASE WHEN cls = 1 THEN 1 WHEN cls = 2 THEN 0 END"
_CLASS = "CASE WHEN o_orderstatus = 'P' THEN 3 WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 1 ELSE 2 END"
_SCORE = "CAST(((tx_id * 7919 + 104729) % 1000) + CASE WHEN cls = 1 AND step < 43 THEN 900 ELSE 0 END AS DOUBLE) / CAST(1900 AS DOUBLE)"


class Tables:
    """The tables of one folder and the views over them; every view is lazy and reads only the columns it names."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def tx(self) -> DataFrame:
        """Transactions: id, step 1 to 49, class 1, 2 or 3, label 1, 0 or null, score, price."""
        days = "datediff(CAST(o_orderdate AS DATE), DATE '1995-01-01')"
        base = self.raw("orders").selectExpr("o_orderkey AS tx_id", f"CAST(1 + floor({days} / 50) AS INT) AS step", f"{_CLASS} AS cls", "o_totalprice AS price")
        return base.selectExpr("tx_id", "step", "cls", f"{_LABEL} AS y", f"{_SCORE} AS score", "price")

    @cached_property
    def addr_tx(self) -> DataFrame:
        """Input address of each transaction."""
        return self.raw("orders").selectExpr("concat('C', o_custkey) AS input_address", "o_orderkey AS tx_id")

    @cached_property
    def lines(self) -> DataFrame:
        """Output address of each line of a transaction; repeats stay."""
        return self.raw("lineitem").selectExpr("l_orderkey AS tx_id", "concat('S', l_suppkey) AS output_address")

    @cached_property
    def tx_addr(self) -> DataFrame:
        """Distinct output addresses of each transaction."""
        return self.lines.distinct()

    @cached_property
    def addr_addr(self) -> DataFrame:
        """Address to address, one row for each line; repeated edges stay."""
        return self.addr_tx.join(self.lines, "tx_id").select("input_address", "output_address")

    @cached_property
    def tx_tx(self) -> DataFrame:
        """From each transaction to the next of the same address within its step."""
        own = self.addr_tx.join(self.tx.select("tx_id", "step"), "tx_id")
        return own.selectExpr("tx_id AS tx_id1", "lead(tx_id) OVER (PARTITION BY input_address, step ORDER BY tx_id) AS tx_id2").where("tx_id2 IS NOT NULL")

    @cached_property
    def wallet_snap(self) -> DataFrame:
        """Snapshots of addresses: the number of transactions up to the step, once for each transaction."""
        parts = parts_for(self.addr_tx.count())
        own = self.addr_tx.repartition(parts, "tx_id").join(self.tx.select("tx_id", "step").repartition(parts, "tx_id"), "tx_id").repartition(parts, "input_address")
        running = "count(*) OVER (PARTITION BY input_address ORDER BY step RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        return own.selectExpr("input_address AS address", "step", f"{running} AS total_txs")

    @cached_property
    def ev(self) -> DataFrame:
        """Events with a daily step, a label and a score."""
        y = "CASE WHEN event_type = 'error' THEN 1 WHEN event_type = 'signup' THEN NULL ELSE 0 END"
        step = "1 + datediff(CAST(ts AS DATE), DATE '2024-01-01')"
        return self.raw("events").selectExpr("event_id", "user_id", "ts", f"{step} AS step", f"{y} AS y", "least(value / 500, 1) AS score")

    @cached_property
    def vec(self) -> DataFrame:
        """Vectors with a step and a side; the first eight components as features."""
        features = [f"CAST(embedding[{i}] AS DOUBLE) AS f{i}" for i in range(8)]
        own = self.raw("embeddings").selectExpr("vec_id", "CAST(vec_id % 49 + 1 AS INT) AS step", "label >= 5 AS side", *features)
        return own.withColumn("f_mono", F.expr("CAST(step AS DOUBLE) + f0"))

    @cached_property
    def doc(self) -> DataFrame:
        """Documents with a label where there is one."""
        labels = self.raw("labels").selectExpr("doc_id", "quality AS y")
        return self.raw("documents").select("doc_id", "n_chars").join(labels, "doc_id", "left").select("doc_id", "y", "n_chars")

    def windows(self) -> DataFrame:
        return self.spark.createDataFrame([(k, lo, hi) for k, (lo, hi) in WINDOWS.items()], "window string, lo int, hi int")

    def steps(self) -> DataFrame:
        """The steps that transactions have."""
        return self.tx.select("step").distinct()

    def spine(self, first: int = FIRST_STEP, last: int = LAST_STEP) -> DataFrame:
        return self.spark.range(first, last + 1).select(F.col("id").cast("int").alias("step"))


_SQL = {
    "tx": f"""select tx_id, step, cls, {_LABEL} y, {_SCORE} score, price from (select o_orderkey tx_id,
        cast(1 + floor(date_diff('day', date '1995-01-01', cast(o_orderdate as date)) / 50) as int) step, {_CLASS} cls, o_totalprice price from orders)""",
    "addr_tx": "select concat('C', o_custkey) input_address, o_orderkey tx_id from orders",
    "tx_addr": "select distinct l_orderkey tx_id, concat('S', l_suppkey) output_address from lineitem",
    "addr_addr": "select concat('C', o_custkey) input_address, concat('S', l_suppkey) output_address from orders join lineitem on o_orderkey = l_orderkey",
    "tx_tx": """select * from (select tx_id tx_id1, lead(tx_id) over (partition by input_address, step order by tx_id) tx_id2 from addr_tx join tx using (tx_id)) where tx_id2 is not null""",
    "wallet_snap": """select input_address address, step, count(*) over (partition by input_address order by step range between unbounded preceding and current row) total_txs
        from addr_tx join tx using (tx_id)""",
    "ev": """select event_id, user_id, ts, 1 + date_diff('day', date '2024-01-01', cast(ts as date)) step,
        case when event_type = 'error' then 1 when event_type = 'signup' then null else 0 end y, least(value / 500, 1) score from events""",
    "vec": f"""select *, step + f0 f_mono from (select vec_id, cast(vec_id % 49 + 1 as int) step, label >= 5 side,
        {", ".join(f"cast(embedding[{i + 1}] as double) f{i}" for i in range(8))} from embeddings)""",
    "doc": "select d.doc_id, l.quality y, d.n_chars from documents d left join labels l using (doc_id)",
    "windows": "select * from (values " + ", ".join(f"('{k}', {lo}, {hi})" for k, (lo, hi) in WINDOWS.items()) + ") w(\"window\", lo, hi)",
    "spine": f"select cast(unnest(range({FIRST_STEP}, {LAST_STEP + 1})) as int) step",
}


def oracle(sql: str) -> str:
    """``sql`` with the views that it names, and those that they name, in front as common table expressions."""
    needed: list[str] = []

    def add(text: str) -> None:
        for name in _SQL:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                add(_SQL[name].replace(f" {name}(", "("))
                if name not in needed:
                    needed.append(name)

    add(sql)
    views = ",\n".join(f"{name} as ({_SQL[name]})" for name in needed)
    body = sql.strip()
    if not views:
        return body
    if re.match(r"with recursive\b", body, re.I):
        return f"with recursive {views},\n{body[14:].strip()}"
    return f"with {views},\n{body[5:].strip()}" if re.match(r"with\b", body, re.I) else f"with {views}\n{body}"
