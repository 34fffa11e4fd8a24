"""Every registered query with oracle SQL gives the rows that DuckDB gives on the same tables."""

import math
import os

import duckdb
import pytest

from steplens import plans

NAMES = sorted(set(plans.queries()) & set(plans.oracle_sql()))


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, sf_dir, duck, name):
    df = plans.queries()[name](spark, sf_dir)
    found = duck.execute(plans.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    theirs = sorted(str(tuple(plain(r[i]) for i in order)) for r in found.fetchall())
    ours = sorted(str(tuple(plain(v) for v in r)) for r in df.collect())
    assert ours == theirs
