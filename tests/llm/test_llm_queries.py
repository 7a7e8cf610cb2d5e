"""Every query of the subpackage runs on the smallest tables and equals its SQL where it has one."""

import pytest

from paperloom.llm import queries as Q
from tests.compare import connect, differences

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, con, name):
    got = Q.QUERIES[name](spark, FOLDER).toPandas()
    assert not got.duplicated(subset=[c for c in got.columns if c not in ("ids", "entities")]).any()
    if name in Q.SQL:
        assert differences(got, con.execute(Q.SQL[name]).df()) == ([], [])
