"""Every query with SQL gives the rows of DuckDB; the others run."""

import pytest
from oracle import connection, differences

from weftline import queries as engine


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(engine.ORACLE_SQL))
def test_equals_sql(spark, sf_dir, con, name):
    assert differences(spark, name, sf_dir, con) == []


@pytest.mark.parametrize("name", sorted(set(engine.QUERIES) - set(engine.ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    assert engine.QUERIES[name](spark, sf_dir).count() > 0
