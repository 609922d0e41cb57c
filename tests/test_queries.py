"""Every query of the catalog beside its SQL; those without SQL must give rows."""

import os

import pytest

from pagewright.plans import catalog
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_sql(spark, con, name):
    assert compare(spark, con, SF, catalog.QUERIES[name], catalog.ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_rows(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    df.write.format("noop").mode("overwrite").save()  # all columns of all rows, which a count would not make
    assert df.limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 200 and set(e.oracle_sql()) <= set(e.queries())
