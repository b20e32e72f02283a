import oracle
import pytest

import __spark_entry__ as contract
from conftest import SMALL
from tilepulse.llm.oracles import SQL
from tilepulse.llm.queries import QUERIES


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SMALL)


def test_the_contract_lists_them():
    names = contract.queries()
    assert set(QUERIES) <= set(names) and "pipeline" in names
    for number in range(1, 11):
        assert sum(name.startswith(f"op{number}_") for name in names) == 1


@pytest.mark.parametrize("name", SQL)
def test_query_equals_its_sql(spark, duck, name):
    assert oracle.differences(QUERIES[name](spark, SMALL), duck, SQL[name]) is None
