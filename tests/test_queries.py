"""Every query of the core against its SQL, or at least to its end, over the smallest tables."""

import pytest

from talefold.plans import registry
from tests.oracle import assert_same

SQL = registry.oracle_sql()


def test_sql_only_for_queries():
    assert set(SQL) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf, name):
    assert_same(registry.queries()[name](spark, sf), SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0


def test_entry(spark, sf):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["query_id", "pick", "id", "title", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_and_batch_agree(spark, sf):
    q = registry.queries()
    assert sorted(map(tuple, q["stream_ingest"](spark, sf).collect())) == sorted(map(tuple, q["batch_ingest"](spark, sf).collect()))
