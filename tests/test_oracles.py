"""Every query with SQL against DuckDB on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from ticklake.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return float(v) if isinstance(v, decimal.Decimal) else v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    found = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    r = duck.execute(ORACLES[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    assert found == sorted((tuple(plain(row[names.index(c)]) for c in columns) for row in r.fetchall()), key=repr)


def test_one_exchange_for_features(spark, sf):
    plan = QUERIES["tob_features_16"](spark, sf)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert physical.count("Exchange hashpartitioning(session_id") == 1
