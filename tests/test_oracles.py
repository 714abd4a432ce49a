import pytest

from collonade.plans import cells, more, projects, publishing  # noqa: F401
from collonade.plans.queries import ORACLES, QUERIES
from oracle import connection, differences


@pytest.fixture(scope="module")
def con(data):
    return connection(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, con, name):
    df = QUERIES[name](spark, data)
    if name in ORACLES:
        assert differences(df, con, ORACLES[name]) == ""
    else:
        assert df.count() >= 0
