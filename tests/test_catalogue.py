"""Every query of the engine against its SQL."""

import pytest
from oracle import DATA, duckdb_rows, spark_rows

import __spark_entry__
from relplan.plans import catalogue

SF = f"{DATA}/sf0.001"


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, name):
    assert spark_rows(catalogue.queries()[name](spark, SF)) == duckdb_rows(catalogue.oracle_sql()[name], SF)


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_filters_and_columns_reach_the_scan(spark):
    plan = catalogue.queries()["selection"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity)" in plan and "l_comment" not in plan and "l_partkey" not in plan
