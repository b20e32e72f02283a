import oracle
import pytest

import __spark_entry__ as contract
from conftest import SMALL
from tilepulse.plans.oracles import SQL
from tilepulse.plans.queries import QUERIES


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SMALL)


def test_every_query_has_its_sql():
    assert set(SQL) == set(QUERIES)


def test_flagship(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_sql(spark, duck, name):
    assert oracle.differences(QUERIES[name](spark, SMALL), duck, SQL[name]) is None
