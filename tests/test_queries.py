import pytest
from harness import compare, connect

from samewise import queries as catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_its_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    if name not in catalogue.ORACLE_SQL:
        assert df.count() > 0
        return
    got, want = compare(df, con, catalogue.ORACLE_SQL[name])
    assert got == want
