"""Every core query runs on the smallest tables and equals its SQL where it has one."""

import pytest

from paperloom.plans import registry
from tests.compare import connect, differences

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    got = registry.queries()[name](spark, FOLDER).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql:
        assert differences(got, con.execute(sql).df()) == ([], [])


def test_every_sql_has_a_query():
    assert registry.oracle_sql().keys() <= registry.queries().keys()
