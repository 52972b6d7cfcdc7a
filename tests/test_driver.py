import pytest

import __spark_entry__ as driver
import check_oracles
from catalog.oracles import ORACLES
from catalog.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return check_oracles.connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(driver.queries()) and set(ORACLES) <= set(driver.oracle_sql())


def test_entry(spark):
    rows = driver.entry(spark).collect()
    assert len(rows) > 30 and {"Name", "Website", "Email"} <= set(rows[0].asDict())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, connection, name):
    same, note = check_oracles.compare(spark, connection, FOLDER, name)
    assert same, note
