"""Every registered query against its SQL counterpart (rows only where there is none)."""

import pytest

from tests.compare import differences
from webloom.plans.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, folder, con):
    result = QUERIES[name](spark, folder)
    if name in ORACLES:
        assert differences(result, con, ORACLES[name]) == []
    else:
        assert result.count() > 0


def test_names_match():
    assert set(ORACLES) <= set(QUERIES)
