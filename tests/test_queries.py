"""Every query of the library runs, and equals its SQL where it has one."""

import pytest
from oracle import connect, same

from sparkstave.plans import registry

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(small_dir):
    return connect(small_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, small_dir, name):
    same(registry.queries()[name](spark, small_dir), con, SQL[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert {r["partition"] for r in entry.entry(spark).collect()} == {"training", "validation", "test"}


def test_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
