import pytest

from gavilla.plans import catalog, oracles
from tests.compare import connect, differences


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_sql(spark, sf, con, name):
    found = catalog.queries()[name](spark, sf).toPandas()
    assert differences(found, con.execute(oracles.ORACLES[name]).df()) == ""
