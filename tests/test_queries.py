import pytest

import __spark_entry__ as entry_file
from compare import connect, differences

FOLDER = "/root/testdata/sf0.001"
ORACLES = entry_file.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(entry_file.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    got = entry_file.queries()[name](spark, FOLDER).toPandas()
    assert differences(got, con.sql(ORACLES[name]).df()) == []


def test_flagship(spark):
    rows = entry_file.entry(spark).collect()
    assert len(rows) == 300 and all(r["prediction"] is not None for r in rows)
