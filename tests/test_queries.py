"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import pytest
from conftest import SMALL, rows_of

from lattica.plans import audits, registry  # noqa: F401


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SMALL).toPandas()
    if name in registry.ORACLE_SQL:
        assert rows_of(got) == rows_of(duck.execute(registry.ORACLE_SQL[name]).df())
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
