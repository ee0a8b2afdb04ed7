"""Every query of the library's own operators against its SQL, or, without SQL, that it gives rows."""

import pytest

import __spark_entry__ as entry
from conftest import same_rows
from tidegauge.plans import registry


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    if name in registry.SQL:
        same_rows(df, duck, registry.SQL[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "health" in df.columns


def test_registry_is_whole():
    assert set(registry.QUERIES) <= set(entry.queries()) and set(registry.SQL) <= set(entry.oracle_sql())
