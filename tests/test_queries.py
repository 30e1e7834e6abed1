import pytest

from quorumlake.plans.registry import FLAGSHIP, ORACLE_SQL, QUERIES
from tests.compare import rows_of, rows_of_sql

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    assert rows_of(spark, QUERIES[name], FOLDER) == rows_of_sql(ORACLE_SQL[name], FOLDER)


def test_flagship_has_rows(spark):
    assert QUERIES[FLAGSHIP](spark, FOLDER).count() > 0
