"""Every core query against its SQL on the smallest tables."""

import pytest

import garimpo.plans.queries  # noqa: F401  (registers the queries)
from compare import duck_rows, spark_rows
from garimpo.plans.registry import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, data, duck):
    names, rows = spark_rows(QUERIES[name](spark, data))
    if name in SQL:
        assert (names, rows) == duck_rows(duck, SQL[name])
    else:
        assert rows


def test_entry_lists_all(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
