"""The keys of a large table are sorted in parts of a bounded number of rows."""

import re

from steplens.plans import integrity
from steplens.sources.tables import Tables


def test_parts_of_keys_grow_in_number_and_not_in_size(spark, sf_dir, monkeypatch):
    """Exchanges were put together by bytes, of which sorted keys have few."""
    monkeypatch.setattr(integrity, "PART_ROWS", 200, raising=False)
    tables = Tables(spark, sf_dir)
    found = integrity.blank_equals_linkless(tables)
    plan = found._jdf.queryExecution().executedPlan().toString()
    parts = tables.lines.count() // 200
    assert len(re.findall(rf"hashpartitioning\(tx_id#\w+, {parts}\), REPARTITION_BY_NUM", plan)) >= 3
    row = found.first()
    assert (row["only_left"], row["only_right"], row["equal"]) == (0, 0, True)


def test_lag_features_deal_rows_by_their_number(spark, monkeypatch):
    from steplens.operators.graph import lag_features
    from steplens.sources import scratch

    monkeypatch.setattr(scratch, "PART_ROWS", 100)
    steps = spark.createDataFrame([(i, i % 40 + 1) for i in range(800)], "tx_id long, step int")
    links = [(i, f"C{i % 13}") for i in range(800)] + [(i, "hot") for i in range(800)]
    snaps = [(f"C{k}", s, float(100 * k + s)) for k in range(12) for s in range(3, 40, 5)]
    found = lag_features(spark.createDataFrame(links * 2, "tx_id long, address string"), steps, spark.createDataFrame(snaps, "address string, step int, v double"), ["v"])
    rows = found.collect()
    assert found.rdd.getNumPartitions() == 32  # 3,200 rows, repeats included
    assert len(rows) == 800
    for r in rows:
        past = [(s, v) for k, s, v in snaps if k == f"C{r['tx_id'] % 13}" and s < r["tx_id"] % 40 + 1]
        assert (r["lag_mean_v"], r["has_history"], r["share"]) == ((max(past)[1], 1, 0.5) if past else (0.0, 0, 0.0))
