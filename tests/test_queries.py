"""Registered queries beside the training-data operators, against their SQL."""

import pytest
from lodestone.plans import catalog

from tests import oracle


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, tiny, name):
    if name in catalog.SQL:
        oracle.compare(spark, catalog.QUERIES[name], catalog.SQL[name], tiny)
    else:
        assert catalog.QUERIES[name](spark, tiny).count()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count()
    assert set(e.oracle_sql()) <= set(e.queries())
