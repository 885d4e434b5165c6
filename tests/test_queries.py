import pytest

import __spark_entry__ as driver
from tests.oracle import same
from tidelog import catalog

SF = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    same(spark, catalog.queries()[name], SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry_and_keys(spark):
    assert driver.entry(spark).columns == ["sender_id", "seq", "message_id"]
    assert set(driver.oracle_sql()) <= set(driver.queries())
