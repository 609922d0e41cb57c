import os

import pytest

from pagewright.llm.registry import ORACLE_SQL, QUERIES
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    assert compare(spark, duck(SF), SF, QUERIES[name], ORACLE_SQL[name]) == ""
