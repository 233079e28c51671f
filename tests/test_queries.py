import pytest

import __spark_entry__ as entry
from inodeon.queries import binary, metadata

from .oracle import differences

SMALL = "/root/testdata/sf0.001"
QUERIES = metadata.QUERIES | binary.QUERIES
SQL = metadata.ORACLE_SQL | binary.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    assert differences(spark, name, QUERIES[name], SQL[name], SMALL) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 25
    assert set(entry.oracle_sql()) <= set(entry.queries())
