"""Every driver query against its SQL in DuckDB."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, differences

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    assert differences(QUERIES[name](spark, FOLDER), duck, ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_model_query_returns_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_models_explain_their_training_rows(spark):
    assert all(r.r2 > 0 for r in QUERIES["fit_models"](spark, FOLDER).collect())


def test_entry_has_rows(spark):
    assert entry.entry(spark).columns == ["State", "District", "Crop", "year", "yield", "price"]
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
