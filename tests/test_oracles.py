"""Every registered query against its SQL, at the smallest scale."""

import pytest
from conftest import SMALL, compare

from quarry import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    if name in catalog.ORACLES:
        compare(spark, catalog.QUERIES[name], catalog.ORACLES[name], SMALL)
    else:
        assert catalog.QUERIES[name](spark, SMALL).count() >= 0
