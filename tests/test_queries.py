"""Every tracking query runs; where SQL can express it, DuckDB agrees."""

import pytest

from matchgrid.plans import registry
from parity import assert_same


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(name, spark, sf_dir, duck):
    df = registry.queries()[name](spark, sf_dir)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert df.columns and df.collect() is not None
    else:
        assert_same(df, duck, sql)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
