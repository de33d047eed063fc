"""Every registered query against its SQL twin: names, types and values."""

import pytest

import __spark_entry__ as entry_point
from tests.compare import connect, oracle_rows, spark_rows

QUERIES, ORACLES = entry_point.queries(), entry_point.oracle_sql()
DUCK_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    rows = entry_point.entry(spark)
    assert rows.count() == 500 and "quality_score" in rows.columns


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns, rows = spark_rows(df)
    assert rows
    assert (columns, rows) == oracle_rows(duck, ORACLES[name])
    described = {c[0]: c[1] for c in duck.execute(f"DESCRIBE {ORACLES[name]}").fetchall()}
    wrong = {c: (t, described[c]) for c, t in df.dtypes if DUCK_TYPES.get(t) != described[c]}
    assert not wrong


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_twin_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
