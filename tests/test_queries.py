"""Every registered query against its SQL counterpart."""

import pytest

import __spark_entry__ as contract
from roundwise.plans import catalogue
from tests.compare import TESTDATA, connect, differences

SF = f"{TESTDATA}/sf0.001"
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    result = QUERIES[name](spark, SF).toArrow()
    expected = duck.sql(ORACLES[name]).to_arrow_table()
    assert differences(result, expected) == []


def test_every_survey_query_has_sql():
    assert set(catalogue.QUERIES) <= set(ORACLES)


def test_entry_runs(spark):
    assert contract.entry(spark).columns == ["sex", "pysum", "events", "rate", "lower_95", "upper_95"]
