"""Steps before the first regime, after the last one and not known at all: the query gives what its SQL gives."""

import duckdb

from steplens import plans


def test_steps_outside_the_regimes(spark, tmp_path):
    orders = """SELECT id AS o_orderkey, id % 50 AS o_custkey, IF(id % 5 = 0, 'P', IF(id % 2 = 0, 'F', 'O')) AS o_orderstatus, CAST(id AS DOUBLE) AS o_totalprice,
        IF(id % 97 = 0, NULL, CAST(date_add(DATE '1994-06-01', CAST(id * 3 % 4000 AS INT)) AS TIMESTAMP)) AS o_orderdate, IF(id % 3 = 0, '1-URGENT', '5-LOW') AS o_orderpriority FROM range(4000)"""
    spark.sql(orders).write.parquet(str(tmp_path / "orders.parquet"))
    df = plans.queries()["regime_context"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    found = con.execute(f"select {', '.join(df.columns)} from ({plans.oracle_sql()['regime_context']})").fetchall()
    assert {r[1] for r in found} > {-3, 0, 50, 60, None}
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, found))
